"""A batch data source for wiki API answers; the transport is a parameter, so tests need no network."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class WikiApiSource(DataSource):
    """Options: titles (JSON list), payloads (JSON object title -> answer) or url with {title}, timeout."""

    @classmethod
    def name(cls) -> str:
        return "wiki_api"

    def schema(self) -> str:
        return "title string, payload string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        titles, size = json.loads(self.options.get("titles", "[]")), int(self.options.get("batch", 50))
        return [InputPartition(titles[i : i + size]) for i in range(0, len(titles), size)] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        known = json.loads(self.options.get("payloads", "{}"))
        for title in partition.value:
            try:
                yield title, json.dumps(known[title]) if title in known else self._fetch(title), None
            except Exception as e:  # one bad title must not fail the corpus
                yield title, None, f"{type(e).__name__}: {e}"

    def _fetch(self, title: str) -> str:
        import urllib.parse
        import urllib.request

        if "url" not in self.options:
            raise LookupError("no payload and no url")
        where = self.options["url"].replace("{title}", urllib.parse.quote(title))
        with urllib.request.urlopen(where, timeout=float(self.options.get("timeout", 30))) as answer:
            return answer.read().decode()
