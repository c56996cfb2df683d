"""Requirement files: JSON documents, lenient JSON lines and split lists."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.common import numbered
from graphloom.functions.text import boilerplate, normal_title

SCHEMA = "id string, sentence_id string, identifier string, title string, text string, meta struct<title:string>, axioms struct<prefixes:map<string,string>,tbox:array<string>,abox:array<string>>, boilerplate struct<prefix:string,main:string,suffix:string>"


def lenient_records(text: str) -> list[dict]:
    """Objects of a JSON document or of JSON lines in which blank lines, ``//`` comments and lone
    commas are skipped and an object may span lines; trailing rubbish is an error."""
    if not text.strip():
        return []
    try:
        doc = json.loads(text)
        return [x for x in (doc if isinstance(doc, list) else [doc]) if isinstance(x, dict)]
    except ValueError:
        pass
    out, buffer = [], ""
    for line in text.splitlines():
        s = line.strip()
        if not s or s.startswith("//") or s == ",":
            continue
        buffer += s + "\n"
        try:
            doc = json.loads(buffer.strip().rstrip(","))
        except ValueError:
            continue
        out += doc if isinstance(doc, list) else [doc]
        buffer = ""
    if buffer.strip():
        raise ValueError(f"a record does not end: {buffer[:60]!r}")
    return [x for x in out if isinstance(x, dict)]


def read(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Records of files, each read whole by one task; ``ord`` counts from 1 within all files by name."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(p, i, json.dumps(r)) for p, t in zip(pdf.path, pdf.value) for i, r in enumerate(lenient_records(t))]
            yield pd.DataFrame(rows, columns=["path", "pos", "payload"])

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    raw = files.mapInPandas(run, "path string, pos bigint, payload string").select("path", "pos", F.from_json("payload", SCHEMA).alias("r")).select("path", "pos", "r.*")
    placed = numbered(raw, "path", "pos", name="ord")
    return shaped(placed.where(F.col("ord") <= limit) if limit is not None else placed)


def identifier(df: DataFrame):
    """The first that is not empty of id, sentence_id, identifier, the normalised titles, REQ-nnn."""
    some = lambda c: F.when(c == "", None).otherwise(c)
    return F.coalesce(some(F.col("id")), some(F.col("sentence_id")), some(F.col("identifier")), some(normal_title(F.col("meta.title"))), some(normal_title(F.col("title"))), F.format_string("REQ-%03d", F.col("ord")))


def shaped(df: DataFrame) -> DataFrame:
    """(ord, identifier, title, text, axioms, boilerplate) with defaults."""
    b = F.col("boilerplate")
    return df.select("ord", identifier(df).alias("identifier"), F.coalesce("title", F.format_string("Requirement %d", "ord")).alias("title"), F.trim(F.coalesce("text", F.lit(""))).alias("text"), "axioms",
                     boilerplate(b["prefix"], b["main"], b["suffix"]).alias("boilerplate"))


def split_ids(spark: SparkSession, path: str) -> DataFrame:
    """(identifier) of a split file, an id a line; a file that is not there is empty, on any file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(conf).exists(at):
        return spark.createDataFrame([], "identifier string")
    return spark.read.text(path).select(F.trim("value").alias("identifier")).where("identifier <> ''").distinct()


def assigned(reqs: DataFrame, splits: dict[str, DataFrame]) -> DataFrame:
    """With ``split``: the first list by name of the dict that holds the identifier, else null."""
    out, found = reqs, []
    for name, ids in splits.items():
        out = out.join(ids.select("identifier").distinct().withColumn(f"_{name}", F.lit(name)), "identifier", "left")
        found.append(f"_{name}")
    return out.withColumn("split", F.coalesce(*found)).drop(*found)


def unmatched(reqs: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.join(reqs.select("identifier"), "identifier", "left_anti")


def batches(reqs: DataFrame, size: int = 5) -> DataFrame:
    """With ``batch``: consecutive groups of ``size`` by ord, from 0. ord is dense from 1."""
    return reqs.withColumn("batch", F.floor((F.col("ord") - 1) / size))


def exemplars(reqs: DataFrame, split: str = "dev", n: int = 6) -> DataFrame:
    """The first ``n`` requirements of a split by order: examples for a generator."""
    return reqs.where(F.col("split") == split).orderBy("ord").limit(n)
