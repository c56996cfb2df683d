"""Deeply nested JSON records -> related flat tables (problem 1).

Each record is read as a stream of the values of its members, a list member element by element, and
each of these is walked as path-value-ordinal triples; so a long log is never held as a whole.
Triples that share
their nearest repeated ancestor (path and ordinals) form one flat row; the ordinals of the
outer ancestors are the key of the parent row. A record never leaves its task, so shredding
needs no shuffle however large one run or one graph becomes.

Defined results: a null payload yields no row; a payload that is not JSON, or nested deeper than
``json.loads`` goes (about 10,000 levels), yields one row in table ``_error``; an empty object that is an element of a list is a row without values; null
elements count for the ordinals but are no rows; of repeated member names the last holds.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.common import pick, spread

ROWS = "rec_id bigint, tbl string, ordinals array<bigint>, member string, kind string, vals map<string,string>"
ROOT = "$"


def _text(v) -> str | None:
    if v is None or isinstance(v, str):
        return v
    return json.dumps(v, ensure_ascii=False)


_BLANK = re.compile(r"[ \t\n\r]*").match
_DECODER = json.JSONDecoder()


class _Repeated(Exception):
    """A member name occurs twice in the record."""


def pieces(text: str) -> Iterator[tuple]:
    """(value, row path, path below the row, ordinals) of a JSON text: the members of the outer object as they are
    read, those that are lists element by element. ValueError where the text is no JSON."""
    at = _BLANK(text, 0).end()
    if text[at : at + 1] != "{":
        value, at = _DECODER.raw_decode(text, at)
        yield value, ROOT, "", ()
        _ended(text, at)
        return
    seen: set[str] = set()
    at = _BLANK(text, at + 1).end()
    more = text[at : at + 1] != "}"
    while more:
        if text[at : at + 1] != '"':
            raise json.JSONDecodeError("a member name is missing", text, at)
        name, at = json.decoder.scanstring(text, at + 1, True)
        if name in seen:
            raise _Repeated
        seen.add(name)
        at = _BLANK(text, at).end()
        if text[at : at + 1] != ":":
            raise json.JSONDecodeError("a colon is missing", text, at)
        at = _BLANK(text, at + 1).end()
        if text[at : at + 1] == "[":
            at, i = _BLANK(text, at + 1).end(), 0
            inside = text[at : at + 1] != "]"
            while inside:
                value, at = _DECODER.raw_decode(text, at)
                if value is not None:
                    yield value, f"{name}[]", "", (i,)
                i += 1
                at, inside = _next(text, at, "]")
            at += 1
        else:
            value, at = _DECODER.raw_decode(text, at)
            yield value, ROOT, name, ()
        at, more = _next(text, at, "}")
    _ended(text, at + 1)


def _next(text: str, at: int, end: str) -> tuple[int, bool]:
    """Where the next item begins, or the end stands."""
    at = _BLANK(text, at).end()
    c = text[at : at + 1]
    if c == ",":
        return _BLANK(text, at + 1).end(), True
    if c != end:
        raise json.JSONDecodeError("a comma is missing", text, at)
    return at, False


def _ended(text: str, at: int) -> None:
    if _BLANK(text, at).end() != len(text):
        raise json.JSONDecodeError("there is more after the end", text, at)


def triples(text: str, repeated: frozenset[str], keyed: frozenset[str]) -> Iterator[tuple[str, tuple, str | None, str, str, object]]:
    """(row path, ordinals, member, kind, path below the row, value) of a JSON text.

    A path is dotted, with ``[]`` after each repeated step and ``{}`` after a keyed one
    (an object whose member names are data). The path below is '' for the row itself.
    """
    if _BLANK(text, 0).end() < len(text) and text[_BLANK(text, 0).end()] == "{":
        yield ROOT, (), None, "object", "", None
    for value, row, below, at in pieces(text):
        yield from walk(value, row, below, at, repeated, keyed)


def walk(value, row: str, below: str, at: tuple, repeated: frozenset[str], keyed: frozenset[str]):
    """The triples of one value that stands ``below`` a row."""
    stack = [(value, row, below, at, None)]
    while stack:
        v, row, below, at, member = stack.pop()
        full = below if row == ROOT else (f"{row}.{below}" if below else row)
        if isinstance(v, list) or (isinstance(v, dict) and below and full in repeated):
            items = v if isinstance(v, list) else [v]
            for i in range(len(items) - 1, -1, -1):
                if items[i] is not None:
                    stack.append((items[i], f"{full}[]", "", (*at, i), None))
        elif isinstance(v, dict) and below and full in keyed:
            for k in reversed(v):
                if v[k] is not None:
                    yield f"{full}{{}}", at, k, "member", "", v[k]
        elif isinstance(v, dict):
            if not below:
                yield row, at, member, "object", "", None
            for k in reversed(v):
                stack.append((v[k], row, f"{below}.{k}" if below else k, at, member))
        else:
            yield row, at, member, "value", below, v


def shred(df: DataFrame, id_col: str, json_col: str, repeated: Iterable[str] = (), keyed: Iterable[str] = ()) -> DataFrame:
    """One row per object (or member of a keyed object) below a repeated ancestor.

    ``repeated``: paths that hold a list as a rule, where an object standing alone is a list
    of one; any other array is repeated as well. ``keyed``: objects whose members are rows.
    """
    rep, key = frozenset(repeated), frozenset(keyed)
    names = [c.split()[0] for c in ROWS.split(", ")]
    types = [pa.int64(), pa.string(), pa.list_(pa.int64()), pa.string(), pa.string(), pa.map_(pa.string(), pa.string())]
    schema = pa.schema(list(zip(names, types)))

    def read(rec, found, add):
        rows: dict[tuple, tuple[str, list]] = {}
        for row, at, member, kind, below, v in found:
            if kind == "member":
                add(rec, row, list(at), member, kind, [("value", _text(v))])
            else:
                got = rows.setdefault((row, at), [kind, []])
                if kind == "object":
                    got[0] = kind
                else:
                    got[1].append((below or "value", _text(v)))
        for (row, at), (kind, vals) in rows.items():
            add(rec, row, list(at), None, kind, vals)

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in names]

            def add(rec, tbl, at, member, kind, vals):
                for column, v in zip(out, (rec, tbl, at, member, kind, vals)):
                    column.append(v)

            for rec, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text is None:
                    continue
                begun = len(out[0])
                try:
                    read(rec, triples(text, rep, key), add)
                except (ValueError, RecursionError, _Repeated) as e:
                    for column in out:
                        del column[begun:]
                    try:
                        if not isinstance(e, _Repeated):
                            raise e
                        read(rec, walk(json.loads(text), ROOT, "", (), rep, key), add)  # of repeated names the last holds
                    except (ValueError, RecursionError) as err:
                        for column in out:
                            del column[begun:]
                        add(rec, "_error", [], None, "error", [("value", str(err))])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], schema=schema)

    src = spread(pick(df, id_col, json_col))
    return src.select(F.col(f"`{id_col}`").cast("bigint"), F.col(f"`{json_col}`")).mapInArrow(run, ROWS)


def columns_of(rows: DataFrame, tbl: str) -> list[str]:
    """The value paths seen in one table, by name: they become its columns, so they have to fit a schema."""
    found = rows.where(F.col("tbl") == tbl).select(F.explode(F.map_keys("vals")).alias("c")).distinct().orderBy("c")
    return [r.c for r in found.toLocalIterator()]


def pivot(rows: DataFrame, tbl: str, columns: list[str] | None = None) -> DataFrame:
    """One flat table: rec_id, ordinals (own key; all but the last are the parent's), member, one column a path."""
    columns = columns_of(rows, tbl) if columns is None else columns
    return rows.where(F.col("tbl") == tbl).select("rec_id", "ordinals", "member", *(F.element_at("vals", F.lit(c)).alias(c) for c in columns))


REPEATED = ("iteration_log", "iteration_log[].cq.results")
KEYED = ("iteration_log[].shacl.violations", "iteration_log[].patches.types")
CHILDREN = {"iteration_log[].cq.results[]": "cq_result", "iteration_log[].shacl.violations{}": "violation", "iteration_log[].patches.types{}": "patch_type"}


def shred_runs(logs: DataFrame) -> DataFrame:
    return shred(logs, "log_id", "payload", REPEATED, KEYED)


def children(rows: DataFrame) -> DataFrame:
    """p1_found: one row per child of an iteration, keyed by run and place of the iteration."""
    name = F.create_map(*(F.lit(x) for kv in CHILDREN.items() for x in kv))
    return (
        rows.where(F.col("tbl").isin(*CHILDREN) & F.col("kind").isin("object", "member"))
        .select(
            F.col("rec_id").alias("log_id"),
            F.col("ordinals")[0].alias("iter_pos"),
            F.element_at(name, F.col("tbl")).alias("child"),
            F.coalesce("member", F.element_at("ordinals", -1).cast("string")).alias("child_key"),
        )
    )


def errors(rows: DataFrame) -> DataFrame:
    """(log_id, error) of the records that cannot be parsed, which have no rows elsewhere."""
    return rows.where("tbl = '_error'").select(F.col("rec_id").alias("log_id"), F.element_at("vals", F.lit("value")).alias("error"))


def run_tables(logs: DataFrame) -> dict[str, DataFrame]:
    """runs, iterations, cq_results, violations and patch_types with parent keys and stable columns."""
    rows = shred_runs(logs)
    num = lambda c, t: F.expr(f"try_cast(`{c}` as {t})")
    runs = pivot(rows, ROOT, ["run", "config.policy", "config.thresholds.cq"]).select(
        F.col("rec_id").alias("log_id"), "run", F.col("`config.policy`").alias("policy"), num("config.thresholds.cq", "double").alias("cq_threshold")
    )
    its = pivot(rows, "iteration_log[]", ["iteration", "shacl.total", "cq.pass_rate", "stop.decision", "stop.reason", "reasoning.notes"]).select(
        F.col("rec_id").alias("log_id"), F.col("ordinals")[0].alias("iter_pos"), num("iteration", "bigint").alias("iteration"), num("shacl.total", "bigint").alias("shacl_total"),
        num("cq.pass_rate", "double").alias("cq_pass_rate"), num("stop.decision", "boolean").alias("stop"), F.col("`stop.reason`").alias("stop_reason"), F.col("`reasoning.notes`").alias("notes"),
    )
    cqs = pivot(rows, "iteration_log[].cq.results[]", ["query", "success", "message"]).select(
        F.col("rec_id").alias("log_id"), F.col("ordinals")[0].alias("iter_pos"), F.col("ordinals")[1].alias("cq_pos"), "query", num("success", "boolean").alias("success"), "message"
    )
    named = lambda t: pivot(rows, t, ["value"]).select(F.col("rec_id").alias("log_id"), F.col("ordinals")[0].alias("iter_pos"), F.col("member").alias("name"), num("value", "bigint").alias("n"))
    return {"runs": runs, "iterations": its, "cq_results": cqs, "violations": named("iteration_log[].shacl.violations{}"), "patch_types": named("iteration_log[].patches.types{}")}
