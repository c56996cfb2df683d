"""Rows that fail to parse (problem 4): keep the raw text, say why.

Every row is read permissively by Spark's CSV reader under an explicit schema that keeps the raw
text of corrupt records. A row is good when the reader finds it whole, its values are in range
and it stands written back as it was read; the reader is lenient (about quotes, signs and zeros),
so a row with a quote, and what the reader had to bend, is suspect as well. Only suspects are classified, by quoting, column count
and casts, in this order; those without a reason are good and take the strict fields. A row gives
its columns or its reason in one pass. All of it stays in the JVM.

Defined results: a null line has no fields (``column_count``), as has an empty one; a null
turtle text has no statement and is good; a text with several faults gets the first reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.common import pick, spread
from graphloom.functions import literals

LINE = "req_no string, title string, text string, split string, created_on date, priority int, _corrupt string"
COLUMNS = ("req_no", "title", "text", "split", "created_on", "priority")
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
_FIELD = rf'(?:{_QUOTED}|[^",]*+)'
_WHOLE = rf"(?s)^{_FIELD}(?:,{_FIELD})*+\z"  # not $, which also matches before a last line break
_NEXT = rf'({_QUOTED}|[^",]*+),'


def real_date(c: Column) -> Column:
    return c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & ~c.startswith("0000") & F.try_to_date(c, "yyyy-MM-dd").isNotNull()


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed a single time however often it is used."""
    return F.transform(F.array(value), use)[0]


def unquoted(c: Column) -> Column:
    return F.when(c.startswith('"'), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)


def _bad_values(f: list[Column]) -> Column:
    return ~(
        f[0].rlike(r"^[0-9]+\z") & f[2].rlike(r"(?U)\S") & f[3].isin("train", "dev", "test", "") & real_date(f[4]) & f[5].rlike(r"^[1-5]\z")
    )


def _read(c: Column, schema: str, **more: str) -> Column:
    return F.from_csv(c, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "escape": '"', "maxCharsPerColumn": "-1", **more})


def _fields(f: list[Column]) -> Column:
    """The six typed columns of fields that are texts."""
    return F.struct(*(x.alias(c) for x, c in zip((*f[:4], F.try_to_date(f[4], "yyyy-MM-dd"), f[5].try_cast("int")), COLUMNS)))


def read_lines(df: DataFrame, id_col: str = "line_id", raw_col: str = "raw_line", bad_only: bool = False) -> DataFrame:
    """(row_id, the six typed columns, raw, reason): reason null for a good row, whose columns are loaded; a bad one keeps its raw text only.

    With ``bad_only`` (row_id, reason) of the bad rows, from the same reading.
    """
    src = pick(df, id_col, raw_col).select(F.col(f"`{id_col}`").cast("bigint").alias("row_id"), F.col(f"`{raw_col}`").alias("raw"))
    raw, none = F.col("raw"), F.lit(None)

    def whole(r: Column) -> Column:
        """The reader found a record that is in range and reads the same when written."""
        texts = [F.coalesce(r[c], F.lit("")) for c in COLUMNS[:4]]
        back = F.concat_ws(",", *texts, F.date_format(r["created_on"], "yyyy-MM-dd"), r["priority"].cast("string"))
        fits = r["req_no"].rlike(r"^[0-9]+\z") & r["text"].rlike(r"(?U)\S") & texts[3].isin("train", "dev", "test", "") & r["priority"].between(1, 5) & F.year(r["created_on"]).between(1, 9999)
        return F.coalesce(r["_corrupt"].isNull() & ~raw.contains('"') & (back == raw) & fits, F.lit(False))

    def strict(pieces: Column) -> Column:
        """The reason of a suspect, or its fields."""
        f = [unquoted(F.get(pieces, F.lit(i))) for i in range(6)]
        why = F.when(raw.isNull(), "column_count").when(pieces.isNull(), "quoting").when(F.size(pieces) != 6, "column_count").when(_bad_values(f), "invalid_value")
        return once(why, lambda w: F.struct(F.when(w.isNull(), _fields(f)).alias("f"), w.alias("reason")))

    def judged(r: Column) -> Column:
        plain = ~raw.contains('"')  # no quotes: the fields are the pieces between commas
        pieces = F.when(plain, F.split(raw, ",", -1)).when(raw.rlike(_WHOLE), F.regexp_extract_all(F.concat(raw, F.lit(",")), F.lit(_NEXT), F.lit(1)))
        # The reader gives null for an empty field.
        loaded = F.struct(*((F.coalesce(r[c], F.lit("")) if i < 4 else r[c]).alias(c) for i, c in enumerate(COLUMNS)))
        return F.when(whole(r), F.struct(loaded.alias("f"), none.cast("string").alias("reason"))).otherwise(once(pieces, strict))

    # A generator, so that no later projection or filter computes a row again.
    out = src.select("row_id", "raw", F.inline(F.array(once(_read(raw, LINE, dateFormat="yyyy-MM-dd"), judged))))
    return out.where("reason is not null").select("row_id", "reason") if bad_only else out.select("row_id", "f.*", "raw", "reason")


_SUFFIX = r'(?:\^\^(?:<[^<>"\s]*+>|[^\s"<>]++)|@[A-Za-z]++(?:-[A-Za-z0-9]++)*+)?'
_LIT = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"' + _SUFFIX
_TERM = rf'(?:{_LIT}|<[^<>"\s]*+>|[^\s"<][^\s"]*+)'
_TOKENS = rf"^{_TERM}(?:\s++{_TERM})*+\z"
_TRIPLE = rf"^(?!\.\s){_TERM}\s++{_TERM}\s++{_TERM}\s++\.\z"
_TYPED = r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"\^\^(?:xsd:|<http://www\.w3\.org/2001/XMLSchema#)(decimal|integer|boolean|dateTime)>?(?=\s|$)'


def bad_typed(kind: Column, lex: Column) -> Column:
    """Not in the lexical space of the type; white space around the value collapses, as XML Schema says."""
    v = F.regexp_replace(lex, r"^[ \t\n\r]+|[ \t\n\r]+$", "")
    return (
        F.when(kind == "decimal", ~v.rlike(literals.DECIMAL))
        .when(kind == "integer", ~v.rlike(literals.INTEGER))
        .when(kind == "boolean", ~v.isin("true", "false", "1", "0"))
        .otherwise(~(v.rlike(literals.DATE_TIME) & literals.days_fit(v)))
    )


def statements(turtle: Column) -> Column:
    lines = F.transform(F.split(turtle, r"\r\n|\n|\r"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(lines, lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("@prefix") & ~x.startswith("```"))


STATEMENT = "s string, p string, o string, dot string, _corrupt string"


def read_turtle(df: DataFrame, id_col: str = "response_id", text_col: str = "turtle", bad_only: bool = False) -> DataFrame:
    """(row_id, statements, raw, reason): reason null for a text all of whose statements can be read.

    A statement is read as a record of four fields between blanks; one of plain names is good as it
    stands, every other (with a literal, an IRI, further blanks) is suspect.
    """
    typed = lambda s: F.exists(F.arrays_zip(F.regexp_extract_all(s, F.lit(_TYPED), F.lit(2)).alias("k"), F.regexp_extract_all(s, F.lit(_TYPED), F.lit(1)).alias("v")), lambda x: bad_typed(x["k"], x["v"]))

    def suspect(s: Column) -> Column:
        names = lambda r: r["_corrupt"].isNull() & (r["dot"] == ".") & (r["s"] != ".") & (F.concat_ws(" ", r["s"], r["p"], r["o"], r["dot"]) == s)
        return F.when(s.rlike(r'["<\t\x0b\f]|\s\s'), True).otherwise(once(_read(s, STATEMENT, sep=" "), lambda r: ~F.coalesce(names(r), F.lit(False))))

    why = lambda st: (
        F.when(F.exists(st, lambda s: ~s.rlike(_TOKENS)), "quoting")
        .when(F.exists(st, lambda s: ~s.rlike(_TRIPLE)), "column_count")
        .when(F.exists(st, lambda s: s.contains("^^") & typed(s)), "invalid_value")
    )
    src = pick(df, id_col, text_col).select(F.col(f"`{id_col}`").cast("bigint").alias("row_id"), F.col(f"`{text_col}`").alias("raw"))
    read = once(statements(F.col("raw")), lambda st: F.struct(st.alias("statements"), once(F.filter(st, suspect), why).alias("reason")))
    out = src.select("row_id", "raw", F.inline(F.array(read)))
    return out.where("reason is not null").select("row_id", "reason") if bad_only else out.select("row_id", "statements", "raw", "reason")


def found(lines: DataFrame, responses: DataFrame) -> DataFrame:
    """p4_found: (row_source, row_id, reason) of every row that cannot be loaded."""
    a = read_lines(spread(lines), bad_only=True).select(F.lit("requirement_lines").alias("row_source"), "row_id", "reason")
    b = read_turtle(spread(responses), bad_only=True).select(F.lit("llm_responses").alias("row_source"), "row_id", "reason")
    return a.unionByName(b)
