"""Wiki markup as token rows, and the groupings over them as windows.

Calls are found first, at any depth, and stand for one lexeme each. The scanner is one pattern of
alternatives in order of precedence: regexp_extract_all gives the lexemes of a text, runs of plain
text included, and CASE expressions name them. Lines are gaps and islands over the token rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.braces import BEGIN, END, LEFT, RIGHT, calls_held, released
from ..functions.text import let
from .rows import ROW, by_row, numbered, spread

# Loops in patterns are possessive, so that they need no stack however long a lexeme is.
_VALUES = r"\"[^\"]*+\"|'[^']*+'"
_ATTRS = rf"(?:[^<>\"']++|{_VALUES})*+"
#: kind, whether only at the start of a line, pattern, what must follow; in order of precedence.
LEXEMES = (
    ("Pre", False, r"(?is:<pre\b[^>]*>.*?(?:</pre\s*>|\z))", ""),
    ("NowikiContent", False, r"(?is:<nowiki\s*/>|<nowiki>.*?</nowiki>)", ""),
    ("Comment", False, r"(?s:<!--.*?(?:-->|\z))", ""),
    ("Call", False, rf"(?s:{BEGIN}.*?{END})", ""),
    ("Redirect", True, r"(?i:#redirec(?:t|cion))\s*:?\s*\[\[[^\]\n]*\]\]", ""),
    ("HeadingOpen", True, r"={2,6}", r"(?=[ \n]|==)"),
    ("Hr", True, r"-{4,}", ""),
    ("ListItem", True, r"(?:\*+|#+|;+|:+)", ""),
    ("TableOpen", True, rf"(?:\{{|{LEFT})\|[^\n]*", ""),
    ("TableClose", True, rf"\|(?:\}}|{RIGHT})", ""),
    ("TableRow", True, r"\|-[^\n]*", ""),
    ("TableCaption", True, r"\|\+", ""),
    ("TableCell", True, r"[|!]", ""),
    ("TableCell", False, r"(?:\|\||!!)", ""),
    ("WikilinkOpen", False, r"\[\[", r"(?!\[)"),
    ("WikilinkClose", False, r"\]\]", ""),
    ("ExtLinkOpen", False, r"\[(?i:https?://|ftp://|mailto:|//)[^\s\]]*", ""),
    ("ExtLinkClose", False, r"\]", ""),
    ("WikilinkPipe", False, r"\|", ""),
    ("Quote", False, r"'{2,}", ""),
    ("HtmlTagClose", False, r"</[A-Za-z][^<>]*>", ""),
    ("SelfClosingTag", False, rf"<[A-Za-z][A-Za-z0-9-]*+(?:[^<>\"'/]++|/(?!>)|{_VALUES})*+/>", ""),
    ("HtmlTagOpen", False, rf"<[A-Za-z][A-Za-z0-9-]*+{_ATTRS}>", ""),
    ("MagicWord", False, r"__[A-Za-z]+__", ""),
    ("ParagraphBreak", False, r"\n{2,}", ""),
    ("Newline", False, r"\n", ""),
)
_ANYWHERE = "|".join(p + ahead for _, start, p, ahead in LEXEMES if not start)
_PLAIN = r"[^\n\[\]|<'_!" + BEGIN[0] + "]"
SCAN = "|".join(f"{'(?m:^)' if start else ''}{p}{ahead}" for _, start, p, ahead in LEXEMES) + rf"|(?:{_PLAIN}++|(?!{_ANYWHERE})[^\n])++"
INLINE = "Text BoldOpen BoldClose ItalicOpen ItalicClose WikilinkOpen WikilinkPipe WikilinkClose ExtLinkOpen ExtLinkSep ExtLinkClose MagicWord Comment NowikiContent".split()
BLOCK_START = "HeadingOpen Hr ListItem TableOpen Redirect".split()
LINE_END = ("Newline", "ParagraphBreak")
WITH_TEXT = "Text Quote Comment NowikiContent".split()
WITH_NAME = "ExtLinkOpen TemplateOpen TplArgOpen ParserFnOpen MagicWord HtmlTagOpen HtmlTagClose SelfClosingTag Redirect".split()


def is_inline(kind: Column) -> Column:
    return kind.isin(INLINE)


def is_block_start(kind: Column) -> Column:
    return kind.isin(BLOCK_START)


def _kind(lexeme: Column, starts_line: Column) -> Column:
    """The first alternative that covers the whole lexeme; line-bound ones only at the start of a line."""
    out = F.lit("Text")
    for kind, start, pattern, _ in reversed(LEXEMES):
        hit = lexeme.rlike(rf"\A(?:{pattern})\z")
        out = F.when(hit & starts_line if start else hit, _call_kind(lexeme) if kind == "Call" else F.lit(kind)).otherwise(out)
    return F.when(lexeme.rlike(rf"\A[^\n\[\]|<'_!={LEFT[0]}{{*#;:-]"), "Text").otherwise(out)


def _call_kind(lexeme: Column) -> Column:
    """The kind of a held call; a pair of braces between two more is an argument's."""
    return F.when(lexeme.startswith(BEGIN + 3 * LEFT), "TplArgOpen").when(lexeme.rlike(rf"\A{BEGIN}{LEFT}{LEFT}\s*#"), "ParserFnOpen").otherwise("TemplateOpen")


def _call_name(lexeme: Column) -> Column:
    """What stands between the braces of a held call, up to the first bar."""
    cut = F.when(lexeme.startswith(BEGIN + 3 * LEFT), 8).otherwise(6)
    return F.trim(F.split_part(released(F.substring(lexeme, cut + 1, F.char_length(lexeme) - 2 * cut)), F.lit("|"), F.lit(1)))


def _payload(kind: Column, lexeme: Column) -> Column:
    name = F.lower(F.regexp_extract(lexeme, r"^</?\s*([A-Za-z][A-Za-z0-9-]*)", 1))
    return (
        F.when(kind == "Comment", F.regexp_replace(F.substring(lexeme, 5, 1 << 30), r"-->\z", ""))
        .when(kind == "NowikiContent", F.regexp_replace(lexeme, r"(?is)^<nowiki\s*/?>|</nowiki>\z", ""))
        .when(kind == "Pre", F.regexp_replace(lexeme, r"(?is)^<pre\b[^>]*>|</pre\s*>\z", ""))
        .when(kind == "Redirect", F.trim(F.regexp_extract(lexeme, r"\[\[([^\]|]*)", 1)))
        .when(kind == "ExtLinkOpen", F.substring(lexeme, 2, 1 << 30))
        .when(kind == "MagicWord", F.regexp_replace(lexeme, "^__|__$", ""))
        .when(kind.isin("HtmlTagOpen", "HtmlTagClose", "SelfClosingTag"), name)
        .when(kind.isin("Text", "Quote", "ListItem"), lexeme)
    )


def parse_attributes(tag: Column) -> Column:
    """k, k=v, k="v" and k='v' of a tag as an array of (k, v), in order."""
    inner = F.regexp_replace(tag, r"(?s)^<[A-Za-z][A-Za-z0-9-]*|/?>\z", "")
    parts = F.regexp_extract_all(inner, F.lit(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?"""), F.lit(0))
    cut = lambda p: F.instr(p, "=")
    key = lambda p: F.when(cut(p) > 0, F.rtrim(F.substring(p, F.lit(1), cut(p) - 1))).otherwise(p)
    value = lambda p: F.when(cut(p) > 0, F.regexp_replace(F.ltrim(F.substring(p, cut(p) + 1, F.char_length(p))), r"""(?s)^(["'])(.*)\1\z""", "$2")).otherwise("")
    return F.transform(parts, lambda p: F.struct(F.lower(key(p)).alias("k"), value(p).alias("v")))


def tokens(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """loom_row, key, tok_idx, line_no, kind, s, level, attrs, lex: a row for each token, EOF as the last.

    lex is the piece of the text that the token stands for; together they are the text. Lexemes are
    found and named within their row; only the texts shuffle, once, by the row's number, which the
    count of lines goes by as well.

    Rows: every input row has a number and tokens of its own, whether its key is null or repeated;
    a null or empty text has EOF alone; other columns are left out.
    """
    lexemes = F.regexp_extract_all(calls_held(F.coalesce("text", F.lit(""))), F.lit(SCAN), F.lit(0))
    found = spread(numbered(docs, key, F.col(text).alias("text"))).select(*by_row(key), lexemes.alias("lex"))
    starts_line = lambda i: (i == 0) | F.coalesce(F.get("lex", i - 1).endswith("\n"), F.lit(False))
    named = F.transform("lex", lambda x, i: F.struct(x.alias("lex"), _kind(x, starts_line(i)).alias("kind")))
    eof = F.array(F.struct(F.lit("").alias("lex"), F.lit("EOF").alias("kind")))
    rows = found.select(*by_row(key), F.posexplode(F.concat(named, eof)).alias("tok_idx", "t"))
    rows = rows.select(*by_row(key), "tok_idx", "t.kind", F.col("t.lex").alias("held"), released(F.col("t.lex")).alias("lex"))
    kind, lex = F.col("kind"), F.col("lex")
    is_call = kind.isin("TplArgOpen", "TemplateOpen", "ParserFnOpen")
    name = _call_name(F.col("held"))
    name = F.when(kind == "ParserFnOpen", F.trim(F.split_part(name, F.lit(":"), F.lit(1)))).otherwise(name)
    attrs = F.when(kind.isin("HtmlTagOpen", "SelfClosingTag"), parse_attributes(lex))
    level = F.when(kind.isin("HeadingOpen", "ListItem", "Quote"), F.char_length(lex))
    rows = rows.select(*by_row(key), "tok_idx", "kind", F.when(is_call, name).otherwise(_payload(kind, lex)).alias("s"), level.alias("level"), attrs.alias("attrs"), "lex")
    return number_lines(rows)


def number_lines(rows: DataFrame) -> DataFrame:
    """Adds line_no: how many line ends come before the token in its row."""
    before = Window.partitionBy(ROW).orderBy("tok_idx").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("line_no", F.coalesce(F.sum(F.col("kind").isin(*LINE_END).cast("int")).over(before), F.lit(0)).cast("int"))


def display(kind: Column, s: Column, level: Column) -> Column:
    """A short readable form of a token."""
    return (
        F.when(kind.isin(WITH_TEXT), F.concat(kind, F.lit('("'), s, F.lit('")')))
        .when(kind.isin(WITH_NAME), F.concat(kind, F.lit("("), s, F.lit(")")))
        .when(kind == "HeadingOpen", F.concat(kind, F.lit("("), level.cast("string"), F.lit(")")))
        .when(kind == "ListItem", F.concat(kind, F.lit("("), F.substring(s, 1, 1), F.lit(", "), level.cast("string"), F.lit(")")))
        .otherwise(kind)
    )


# ---------------------------------------------------------------- quotes


def quote_parity(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row and line the number of italic and bold quote runs and whether both are odd."""
    n = F.col("level")
    quotes = rows.where("kind = 'Quote'").withColumn("level", F.when(n == 4, 3).when(n > 5, 5).otherwise(n))
    counts = quotes.groupBy(*by_row(key), "line_no").agg(F.count_if(F.col("level").isin(2, 5)).alias("italic"), F.count_if(F.col("level").isin(3, 5)).alias("bold"))
    return counts.withColumn("unbalanced", (F.col("italic") % 2 == 1) & (F.col("bold") % 2 == 1)).drop(*([] if key == ROW else [ROW]))


def _odd_pair(chunks: Column) -> Column:
    """Place of the bold run to be taken as an apostrophe and an italic run, or null.

    Of the first bold run after a single-letter word, after a longer word and after a space, the
    first that exists counts; only if a line has odd numbers of both kinds.
    """
    sizes = lambda *of: F.size(F.filter(chunks, lambda c: c["n"].isin(*of)))
    odd = (sizes(2, 5) % 2 == 1) & (sizes(3, 5) % 2 == 1)
    bold = F.filter(F.transform(chunks, lambda c, i: F.struct(
        F.when((c["before"] == "") | c["before"].endswith(" "), 3).when((F.char_length(c["before"]) == 1) | F.substring(c["before"], -2, 1).isin(" "), 1).otherwise(2).alias("rank"), i.alias("at"), c["n"].alias("n"))), lambda c: c["n"] == 3)
    return F.when(odd, F.get(F.array_sort(bold), 0)["at"])


#: state -> quote -> (text put out, next state). States: what is open, outermost first; P5 waits.
_STEPS = {
    "": {2: ("<i>", "i"), 3: ("<b>", "b"), 5: ("", "P")},
    "b": {2: ("<i>", "bi"), 3: ("</b>", ""), 5: ("</b><i>", "i")},
    "i": {2: ("</i>", ""), 3: ("<b>", "ib"), 5: ("</i><b>", "b")},
    "bi": {2: ("</i>", "b"), 3: ("</i></b><i>", "i"), 5: ("</i></b>", "")},
    "ib": {2: ("</b></i><b>", "b"), 3: ("</b>", "i"), 5: ("</b></i>", "")},
}
_AT_END = {"": "", "b": "</b>", "i": "</i>", "bi": "</i></b>", "ib": "</b></i>"}
#: What a waiting 5-quote turns out to be, by the quote that follows: its own text, text now, state.
_WAITING = {2: ("<b><i>", "</i>", "b"), 3: ("<i><b>", "</b>", "i"), 5: ("<i><b>", "</b></i>", "")}


def inline_quotes(line: Column) -> Column:
    """A line with its quote runs turned into balanced <b> and <i> tags: a fold over its runs."""
    runs = F.regexp_extract_all(line, F.lit("'{2,}"), F.lit(0))
    texts = F.split(line, "'{2,}", -1)
    chunk = lambda t, r: F.struct(
        F.concat(F.coalesce(t, F.lit("")), F.when(F.length(r) == 4, "'").when(F.length(r) > 5, F.repeat(F.lit("'"), F.length(r) - 5)).otherwise("")).alias("before"),
        F.when(F.length(r) == 4, 3).when(F.length(r) > 5, 5).otherwise(F.coalesce(F.length(r), F.lit(0))).alias("n"),
    )

    def balanced(chunks: Column) -> Column:
        return let(_odd_pair(chunks), lambda wrong: F.transform(chunks, lambda c, i: F.when(i == wrong, F.struct(F.concat(c["before"], F.lit("'")).alias("before"), F.lit(2).alias("n"))).otherwise(F.struct(c["before"].alias("before"), c["n"].alias("n")))))

    fixed = let(F.zip_with(texts, runs, chunk), balanced)

    def step(state: Column, c: Column) -> Column:
        def to(done, held, now):
            return F.struct(done.alias("done"), held.alias("held"), F.lit(now).alias("now"))

        done, held, now, none = state["done"], state["held"], state["now"], F.lit("")
        waiting = now == "P"
        tail = F.concat(held, c["before"])
        out = F.struct(F.when(waiting, done).otherwise(F.concat(done, c["before"])).alias("done"), F.when(waiting, tail).otherwise(none).alias("held"), now.alias("now"))
        for n in (2, 3, 5):
            own, text, then = _WAITING[n]
            out = F.when((c["n"] == n) & waiting, to(F.concat(done, F.lit(own), tail, F.lit(text)), none, then)).otherwise(out)
            for open_now, steps in _STEPS.items():
                text, then = steps[n]
                out = F.when((c["n"] == n) & (now == open_now), to(F.concat(done, c["before"], F.lit(text)), none, then)).otherwise(out)
        return out

    def finish(state: Column) -> Column:
        end = F.concat(state["done"], F.lit("<b><i>"), state["held"], F.lit("</i></b>"))
        for open_now, text in _AT_END.items():
            end = F.when(state["now"] == open_now, F.concat(state["done"], F.lit(text))).otherwise(end)
        return end

    start = F.struct(F.lit("").alias("done"), F.lit("").alias("held"), F.lit("").alias("now"))
    return F.when(F.contains(line, F.lit("''")), F.aggregate(fixed, start, step, finish)).otherwise(line)


# ---------------------------------------------------------------- groups


def list_groups(rows: DataFrame, key: str, order: str, kind: str) -> DataFrame:
    """Adds group_no: neighbours of the same kind share one (gaps and islands).

    Rows: a row without a kind is like its neighbour without one, and like what comes before the first row.
    """
    w = Window.partitionBy(key).orderBy(order)
    new = (~F.col(kind).eqNullSafe(F.lag(kind).over(w))).cast("int")
    return rows.withColumn("new_group", new).withColumn("group_no", F.sum("new_group").over(w).cast("int")).drop("new_group")


def kind_counts(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    return rows.groupBy(key, "kind").agg(F.count(F.lit(1)).alias("n"))


def any_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a | b, tests)
