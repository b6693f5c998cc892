"""User functions and extension tag handlers, registered by name and applied as vectorised functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

TRANSIENT_ERRORS = ("DataSource", "LuaTimeout")


def is_transient(code: Column) -> Column:
    return code.isin(*TRANSIENT_ERRORS)


def _as_text(value: object) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    return str(value) if isinstance(value, (str, int, float)) else ""


def _vectorised(function: Callable[[list[str]], object]):
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield rows.map(lambda values: _as_text(function([] if values is None else list(values))))

    return run


class Modules:
    """name -> function of a list of argument strings; the result becomes text, anything else ''."""

    def __init__(self):
        self.functions: dict[str, Callable[[list[str]], object]] = {}

    def register(self, name: str, function: Callable[[list[str]], object]) -> None:
        self.functions[name] = function

    def __contains__(self, name: str) -> bool:
        return name in self.functions

    def call(self, name: str, args: Column) -> Column:
        return _vectorised(self.functions[name])(args)

    def to_sql(self, spark: SparkSession, name: str) -> None:
        """Makes the function known to SQL under its name; values are those of call()."""
        spark.udf.register(name, _vectorised(self.functions[name]))


class ExtensionTags:
    """tag -> function(body, attributes) giving a Column; tags without one keep their source."""

    def __init__(self):
        self.handlers: dict[str, Callable[[Column, Column], Column]] = {}

    def register(self, tag: str, handler: Callable[[Column, Column], Column]) -> None:
        self.handlers[tag.lower()] = handler

    def get(self, tag: str) -> Callable[[Column, Column], Column] | None:
        return self.handlers.get(tag.lower())

    def __contains__(self, tag: str) -> bool:
        return tag.lower() in self.handlers

    def apply(self, text: Column) -> Column:
        """text with every <tag ...>body</tag> of a registered tag replaced by its handler's value."""
        for tag, handler in self.handlers.items():
            text = _handled(text, tag, handler)
        return text


def _handled(text: Column, tag: str, handler: Callable[[Column, Column], Column]) -> Column:
    found = F.regexp_extract_all(text, F.lit(rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>"), F.lit(0))

    def put(text: Column, m: Column) -> Column:
        body = F.regexp_extract(m, rf"(?is)^<{tag}\b[^>]*>(.*)</{tag}\s*>$", 1)
        attrs = F.trim(F.regexp_extract(m, rf"(?is)^<{tag}\b([^>]*)>", 1))
        return F.replace(text, m, handler(body, attrs))

    return F.aggregate(F.array_distinct(found), text, put)
