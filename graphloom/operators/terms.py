"""Frequency of every term and n-gram (problem 7): suffix-sorted counting.

Each record is a sequence of terms. For every position the suffix, truncated to ``n`` terms,
is routed by its first term; a task sorts its suffixes in reverse lexicographic order and
aggregates the counts of all prefixes with a stack, so each n-gram is counted without ever
being emitted for itself.

Record sets need no sets: a suffix carries the length ``old`` of its longest prefix that
began earlier in the same record; prefixes longer than that are new to the record. Equal
(suffix, old) pairs are added up before the shuffle, so a hot term costs one row per task and
distinct suffix. A first term's suffixes are spread over ``SPREAD`` routes by the second term;
only the count of the first term by itself is then added over routes.

Defined results: a null field has no terms; a record delivered several times counts once,
with the terms of all its different texts.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.common import pick

SPREAD = 16
NAME = r"[A-Za-z_][A-Za-z0-9_.\-]*:[\p{L}\p{N}_](?:[\p{L}\p{N}_.\-]*[\p{L}\p{N}_\-])?"
IRI = r"<http://([A-Za-z_][A-Za-z0-9_\-]*)\.example\.org/ns#([^>\s]+)>"


def prefixed_names(c: Column) -> Column:
    """All prefixed names in a text; a bracketed IRI of the reserved hosts is one."""
    return F.regexp_extract_all(F.regexp_replace(c, IRI, " $1:$2 "), F.lit(f"({NAME})"))


def sequences(df: DataFrame, id_col: str, fields: dict[str, str]) -> DataFrame:
    """(field_name, terms) per record and field with at least one term; fields: name -> column."""
    src = pick(df, id_col, *fields.values()).where(F.col(f"`{id_col}`").isNotNull())
    once = src.groupBy(F.col(f"`{id_col}`").alias("rid")).agg(*(F.array_sort(F.collect_set(c)).alias(c) for c in fields.values()))
    each = F.array(*(F.struct(F.lit(name).alias("field_name"), F.flatten(F.transform(F.col(c), prefixed_names)).alias("terms")) for name, c in fields.items()))
    return once.select(F.explode(each).alias("x")).select("x.*").where(F.size("terms") > 0)


#: Terms of a record up to which each place is compared with those before it; longer ones are sorted.
SHORT = 8


def suffixes(seqs: DataFrame, n: int, short: int = SHORT) -> DataFrame:
    """(field_name, suffix, old) with its number of occurrences ``c``."""
    pos = F.sequence(F.lit(0), F.size("terms") - 1)
    sub = lambda i, k: F.slice(F.col("terms"), i + 1, k)

    def old(i):
        """Longest k for which the k-gram at i began before i."""
        best = F.lit(0)
        for k in range(1, n + 1):
            seen = F.exists(F.sequence(F.lit(0), i - 1), lambda j: sub(j, k) == sub(i, k))
            best = F.when((i > 0) & (i + k <= F.size("terms")) & seen, F.lit(k)).otherwise(best)
        return best

    def repeats(k):
        """By place: the k-gram there began before. Equal grams stand together when sorted, the first of them is new."""
        grams = F.array_sort(F.transform(F.sequence(F.lit(0), F.size("terms") - k), lambda i: F.struct(sub(i, k).alias("g"), i.alias("i"))))
        told = lambda all_: F.transform(all_, lambda x, at: F.struct(x["i"].alias("i"), ((at > 0) & (F.get(all_, at - 1)["g"] == x["g"])).alias("r")))
        by_place = F.transform(F.array_sort(F.transform(F.array(grams), told)[0]), lambda x: x["r"].cast("int"))
        return F.when(F.size("terms") >= k, by_place).otherwise(F.array().cast("array<int>"))

    def sorted_old(flags):
        # A gram that began before has prefixes that did, so the count of lengths is the longest of them.
        return lambda i: sum((F.coalesce(F.get(f, i), F.lit(0)) for f in flags), F.lit(0))

    each = lambda o: F.transform(pos, lambda i: F.struct(sub(i, n).alias("suffix"), o(i).alias("old")))
    long = F.size("terms") > short
    flagged = F.transform(F.array(F.struct(*(repeats(k).alias(f"k{k}") for k in range(1, n + 1)))), lambda r: each(sorted_old([r[f"k{k}"] for k in range(1, n + 1)])))[0]
    out = seqs.select("field_name", F.explode(F.when(long, flagged).otherwise(each(old))).alias("x"))
    return out.groupBy("field_name", F.col("x.suffix").alias("suffix"), F.col("x.old").alias("old")).agg(F.count("*").alias("c"))


COUNTS = "field_name string, gram array<string>, occurrences bigint, records bigint"


def _stack(batches):
    """Prefix counts of suffixes that come in reverse lexicographic order, by a stack.

    stack[k] = [term, occurrences, records] of the prefix of length k + 1.
    """
    schema = pa.schema([("field_name", pa.string()), ("gram", pa.list_(pa.string())), ("occurrences", pa.int64()), ("records", pa.int64())])
    stack: list[list] = []
    field = route = None
    out: list[tuple] = []

    def pop(to: int) -> None:
        while len(stack) > to:
            gram = [s[0] for s in stack]
            _, occ, rec = stack.pop()
            out.append((field, gram, occ, rec))
            if stack:
                stack[-1][1] += occ

    def flush():
        nonlocal out
        rows, out = out, []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)] if rows else [pa.array([], t) for t in schema.types], schema=schema)

    for b in batches:
        for f, r, suffix, old, c in zip(*(b.column(i).to_pylist() for i in range(5))):
            if (f, r) != (field, route):
                pop(0)
                field, route = f, r
            same = 0
            while same < min(len(stack), len(suffix)) and stack[same][0] == suffix[same]:
                same += 1
            pop(same)
            stack.extend([t, 0, 0] for t in suffix[same:])
            stack[-1][1] += c
            for k in range(old, len(suffix)):
                stack[k][2] += c
        yield flush()
    pop(0)
    yield flush()


def ngram_counts(seqs: DataFrame, n: int = 1) -> DataFrame:
    """(field_name, gram, occurrences, records) of every n-gram of up to ``n`` terms."""
    suf = suffixes(seqs, n).withColumn("route", F.xxhash64("field_name", F.col("suffix")[0], F.pmod(F.xxhash64(F.get("suffix", F.lit(1))), F.lit(SPREAD))))
    part = (
        suf.repartition("route")
        .sortWithinPartitions("field_name", "route", F.desc("suffix"))
        .select("field_name", "route", "suffix", "old", "c")
        .mapInArrow(_stack, COUNTS)
    )
    return part.groupBy("field_name", "gram").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked(seqs: DataFrame, rare: int = 2, common: float = 0.05) -> DataFrame:
    """Terms with counts and the mark ``rare``, ``common`` or none."""
    totals = F.broadcast(seqs.groupBy("field_name").agg(F.count("*").alias("total")))  # a row per field
    n = F.col("records")
    mark = F.when(n <= rare, "rare").when(n > F.col("total") * F.lit(common), "common")
    return ngram_counts(seqs, 1).join(totals, "field_name").select("field_name", F.col("gram")[0].alias("term"), "occurrences", "records", mark.alias("mark"))


def field_terms(patches: DataFrame, results: DataFrame) -> DataFrame:
    return sequences(patches, "patch_id", {"patches.source_shape": "source_shape"}).unionByName(
        sequences(results, "result_id", {"validation_results.constraint_component": "constraint_component", "validation_results.path": "path"})
    )
