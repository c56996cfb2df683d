"""Reports: JSON texts per graph, in numbered parts where it is large; optional parts only where there is something."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.common import keep, numbered
from graphloom.model import COLUMNS, SH, TYPE, XSD
from graphloom.operators import shapes

#: Rows of a list in one part of a report.
PART = 1000


def report_json(graphs: DataFrame, results: DataFrame, answers: DataFrame, patches: DataFrame | None = None, size: int = PART) -> DataFrame:
    """(graph_id, part, report). Lists are whole and in order, ``size`` rows of each in a part; parts count from 1.

    The first part has the counts and the questions, each part says how many there are.
    """
    graphs = graphs.select("graph_id").where("graph_id is not null").dropDuplicates()
    found = _ordered(results, [c for c in shapes.RESULT if c != "graph_id"])
    summary = shapes.summary(found.select("graph_id", "r.severity"), "graph_id").withColumn("part", F.lit(1))
    cqs = answers.groupBy("graph_id").agg(F.count("*").alias("cq_total"), F.count_if("success").alias("cq_passed"), F.array_sort(F.collect_list(F.struct("cq_id", "success", "message"))).alias("cqs")).withColumn("part", F.lit(1))  # a question list
    lists = [_parts(found, "results", size)]
    if patches is not None:
        lists.append(_parts(_ordered(patches, ["action", "subject", "predicate", "object"]), "patches", size))
    out = graphs.withColumn("parts", F.lit(1))
    for _, n in lists:
        out = out.join(n, "graph_id", "left").withColumn("parts", F.greatest("parts", "n")).drop("n")
    out = out.withColumn("part", F.explode(F.sequence(F.lit(1), F.col("parts"))))
    for rows in (summary, cqs, *(rows for rows, _ in lists)):
        out = out.join(rows, ["graph_id", "part"], "left")
    counts = F.struct(*(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "hard", "soft")))
    body = [
        "graph_id", "part", "parts", F.when(F.col("part") == 1, counts).alias("validation"),
        F.when(F.size("results") > 0, F.col("results")).alias("results"), F.when(F.col("cq_total") > 0, F.struct("cq_total", "cq_passed", "cqs")).alias("questions"),
    ]
    if patches is not None:
        body.append(F.when(F.size("patches") > 0, F.col("patches")).alias("patches"))
    return out.select("graph_id", "part", F.to_json(F.struct(*body)).alias("report"))


def _ordered(df: DataFrame, cols: list[str]) -> DataFrame:
    """(graph_id, r, pos): the rows in order. They are sorted by range, so that a large graph is no single task."""
    return numbered(df.where("graph_id is not null").select("graph_id", F.struct(*cols).alias("r")), "graph_id", "r")


def _parts(rows: DataFrame, name: str, size: int) -> tuple[DataFrame, DataFrame]:
    """(graph_id, part, ``name``): each graph's rows in order, ``size`` in a part; and (graph_id, n), its number of parts."""
    per = keep(rows.groupBy("graph_id").agg(F.min("pos").alias("first"), F.ceil(F.count("*") / size).cast("int").alias("n")), "parts")
    part = (F.floor((F.col("pos") - F.col("first")) / size) + 1).cast("int")
    cut = rows.join(per, "graph_id").select("graph_id", part.alias("part"), "pos", "r")
    lists = cut.groupBy("graph_id", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "r"))), lambda x: x["r"]).alias(name))
    return lists, per.select("graph_id", "n")


def save(rows: DataFrame, path: str) -> None:
    rows.select("report").write.mode("overwrite").text(path)


def save_plan(patches: DataFrame, path: str) -> None:
    """A patch plan as JSON lines in order, by Spark; see ``plan_text`` for one small text."""
    patches.orderBy("subject", "predicate", "object").write.mode("overwrite").json(path)


def plan_text(patches: DataFrame) -> str:
    """One JSON text of a whole patch plan, in order; read partition by partition."""
    rows = [r.asDict() for r in patches.orderBy("subject", "predicate", "object").toLocalIterator()]
    return json.dumps(rows, indent=2)


def report_graph(graphs: DataFrame, results: DataFrame, bad: DataFrame | None = None) -> DataFrame:
    """A validation report as triples, a graph each: its node, sh:conforms, and a node per result.

    Result nodes are named by a digest of the result, so that equal results are one.
    """
    node = F.concat(F.lit("_:report_"), F.md5("graph_id"))
    verdict = shapes.conforms(results, graphs, bad).select("graph_id", node.alias("r"), F.col("conforms").cast("string").alias("conforms"))
    none = F.lit(None).cast("string")
    st = lambda s, p, o, kind, dt=None: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), F.lit(dt).cast("string").alias("o_dt"))
    col = F.col
    heads = verdict.select("graph_id", F.explode(F.array(st(col("r"), TYPE, F.lit(SH + "ValidationReport"), "iri"), st(col("r"), SH + "conforms", col("conforms"), "lit", XSD + "boolean"))).alias("t"))
    parts = [c for c in shapes.RESULT if c != "graph_id"]
    own = F.concat(F.lit("_:result_"), F.md5(F.to_json(F.struct("graph_id", *parts))))
    kept = results.where("graph_id is not null").select("graph_id", node.alias("r"), own.alias("x"), *parts)
    severity = F.concat(F.lit(SH), F.element_at(F.split(F.coalesce("severity", F.lit("Violation")), "[#:]"), -1))
    member = [
        st(col("r"), SH + "result", col("x"), "bnode"), st(col("x"), TYPE, F.lit(SH + "ValidationResult"), "iri"), st(col("x"), SH + "resultSeverity", severity, "iri"), st(col("x"), SH + "focusNode", col("focus_node"), "iri"), st(col("x"), SH + "resultPath", col("path"), "iri"),
        st(col("x"), SH + "resultMessage", col("message"), "lit", XSD + "string"), st(col("x"), SH + "sourceShape", col("source_shape"), "iri"), st(col("x"), SH + "sourceConstraintComponent", col("component"), "iri"), st(col("x"), SH + "value", col("value"), "lit", XSD + "string"),
    ]
    body = kept.select("graph_id", F.explode(F.array(*member)).alias("t")).where("t.o is not null")
    out = heads.unionByName(body).select("graph_id", "t.s", F.lit("bnode").alias("s_kind"), "t.p", "t.o", "t.o_kind", "t.o_dt", none.alias("o_lang"))
    return out.select(*COLUMNS).dropDuplicates()


def report_lines(graphs: DataFrame, results: DataFrame) -> DataFrame:
    """(graph_id, line): the report as text, a line per result and one for the verdict."""
    said = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f" {name}="), c)).otherwise("")
    each = results.select("graph_id", F.concat(F.coalesce("severity", F.lit("Violation")), F.lit(": "), F.coalesce("message", F.lit("-")), said("focus", "focus_node"), said("path", "path"), said("value", "value"), said("shape", "source_shape")).alias("line"))
    verdict = shapes.conforms(results, graphs).select("graph_id", F.concat(F.lit("conforms: "), F.col("conforms").cast("string")).alias("line"))
    return verdict.unionByName(each)
