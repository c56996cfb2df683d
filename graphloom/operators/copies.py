"""Copies hidden by formatting (problem 5): progressive partition refinement.

1. Cheap invariants for every record, on the map side: stripped lengths of title and text
   and the counts of a few letter groups. Only classes with several members go on.
2. Inside those classes members are told apart by the costlier key, a digest of the whole stripped
   record. It is taken where the record is parsed, since to parse and strip it a second time
   costs several times a digest; so texts are read once and never shuffled.
3. Groups are counted with map-side partial aggregation, so that one record copied over and
   over reduces to a row per task; AQE splits a hot key where members meet their group.

Defined results: a payload that is not a JSON object is no record and belongs to no group; a
missing, null or empty title or text is the empty string; other members do not matter; two
rows with one rec_id and equal content count as one member.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.common import keep, pick, spread

#: Letter groups of the histogram, chosen to split English text about evenly.
GROUPS = ("eqz", "tjv", "aok", "inx", "rsw")


def stripped(c: Column) -> Column:
    """Letters and digits only, in lower case; null is empty."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def invariants(title: Column, text: Column) -> Column:
    counts = [F.length(text) - F.length(F.translate(text, g, "")) for g in GROUPS]
    return F.xxhash64(F.length(title), F.length(text), *counts)


def digest(title: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws("\u0001", title, text)))


def members(df: DataFrame, id_col: str = "rec_id", json_col: str = "payload") -> DataFrame:
    """(rec_id, key) of every record whose cheap invariants are shared, kept as a table."""
    read = F.from_json(F.col(f"`{json_col}`"), "title string, text string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    base = (
        spread(pick(df, id_col, json_col))
        .select(F.col(f"`{id_col}`").cast("bigint").alias("rec_id"), read.alias("r"))
        .where(F.col("rec_id").isNotNull() & F.col("r").isNotNull() & F.col("r._bad").isNull())
        .select("rec_id", stripped(F.col("r.title")).alias("title"), stripped(F.col("r.text")).alias("text"))
        .select("rec_id", invariants(F.col("title"), F.col("text")).alias("cls"), digest(F.col("title"), F.col("text")).alias("key"))
    )
    base = keep(base, "invariants")  # a few bytes a record
    several = base.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1").select("cls")
    return keep(base.join(several, "cls").select("rec_id", "key"), "copies")


def groups(m: DataFrame) -> DataFrame:
    return m.groupBy("key").agg(F.min("rec_id").alias("keep_id"), F.count("*").alias("n")).where("n > 1")


def found(df: DataFrame) -> DataFrame:
    """p5_found: (keep_id, dup_id), keep_id the smallest rec_id of the group."""
    m = members(df)
    return m.join(groups(m), "key").where("rec_id > keep_id").select("keep_id", F.col("rec_id").alias("dup_id"))


def collapsed(df: DataFrame) -> DataFrame:
    """One row per distinct record that has copies: keep_id and the number of members."""
    return groups(members(df)).select("keep_id", F.col("n").alias("copies"))
