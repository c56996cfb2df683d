"""Whole runs: draft, clean, reason, validate, question, repair and score, from one configuration.

A run covers one or many domains at once; a domain is a graph. Artefacts are written by Spark,
texts of one graph (Turtle, prompts) only where they are asked for.
"""

from __future__ import annotations

import functools
import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.common import keep
from graphloom.functions.text import BANKING, Rules, repaired, strip_fence
from graphloom.model import COLUMNS, STANDARD, frame, normalize_base
from graphloom.operators import clean, closure, context, score, shapes
from graphloom.plans import drafting, loop, report
from graphloom.plans.sparql import Engine, split_queries
from graphloom.sources import formats
from graphloom.sources import requirements as req
from graphloom.sources import turtle


@dataclass
class Config:
    """A run of one domain. Paths that are not given leave their step out."""

    name: str
    requirements: str
    base: str = "http://example.org/onto"
    shapes: str | None = None
    questions: str | None = None
    gold: str | None = None
    vocabulary: str | None = None
    base_graph: str | None = None
    splits: dict[str, str] = field(default_factory=dict)
    generator: str = "rules"
    limit: int | None = None
    batch_size: int = 5
    reason: bool = True
    draft_only: bool = False
    policies: list[str] = field(default_factory=lambda: ["hard_and_cq"])
    thresholds: list[float] = field(default_factory=lambda: [0.8])
    max_iterations: int = 3
    min_patch_iterations: int = 0
    prefix: str = "ex"
    output: str | None = None

    def __post_init__(self):
        self.base = normalize_base(self.base)
        if isinstance(self.policies, str):
            self.policies = [p.strip() for p in self.policies.split(",") if p.strip()]
        if self.max_iterations < 1:
            raise ValueError("max_iterations must be above 0")
        if self.gold and self.vocabulary and Path(self.gold).resolve() == Path(self.vocabulary).resolve():
            raise ValueError("the gold graph must not be the vocabulary that the draft sees")


def load_config(path: str, **override) -> list[Config]:
    """Configurations of a JSON file: one object, or {"domains": [...]} with shared members beside it."""
    doc = json.loads(Path(path).read_text(encoding="utf-8"))
    shared = {k: v for k, v in doc.items() if k != "domains"}
    known = {f.name for f in fields(Config)}
    out = []
    for d in doc.get("domains", [{}]):
        members = shared | d | {k: v for k, v in override.items() if v is not None}
        unknown = set(members) - known
        if unknown:
            raise ValueError(f"unknown members: {', '.join(sorted(unknown))}")
        out.append(Config(**members))
    return out


def _text(path: str | None) -> str | None:
    if path is None:
        return None
    if not Path(path).exists():
        raise FileNotFoundError(path)
    return Path(path).read_text(encoding="utf-8")


def read_turtle(spark: SparkSession, text: str, graph: str) -> DataFrame:
    """A Turtle text as it is; where it cannot be parsed, its repaired form, or TurtleError."""
    try:
        return turtle.load(spark, text, graph)
    except turtle.TurtleError:
        df = spark.createDataFrame([(graph, text)], "doc string, text string").withColumn("text", strip_fence(F.col("text")))
        return turtle.load(spark, repaired(df).first().text, graph)


def read_graph(spark: SparkSession, path: str, graph: str) -> DataFrame:
    """A graph file of any format, read by the tasks; a Turtle text that cannot be parsed as it is is repaired first, or is an error."""
    if formats.guess(path) in ("nt", "nquads", "xml"):
        return formats.load(spark, path).withColumn("graph_id", F.lit(graph))
    whole = spark.read.text(path, wholetext=True).select(F.lit(graph).alias("doc"), F.col("value").alias("text"))
    plain = keep(formats.parse_column(whole, "doc", "text"), "graph")
    if not plain.isEmpty():
        return plain
    return formats.parse_column(repaired(whole.withColumn("text", strip_fence(F.col("text")))), "doc", "text", strict=True)


def draft(spark: SparkSession, c: Config, rules: Rules = BANKING, registry: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(triples, requirements with split and batch) of one domain."""
    rs = req.read(spark, c.requirements, c.limit)
    rs = req.batches(req.assigned(rs, {n: req.split_ids(spark, p) for n, p in c.splits.items()}) if c.splits else rs.withColumn("split", F.lit(None).cast("string")), c.batch_size)
    g = drafting.generator(c.generator, rules, c.base, {c.prefix: c.base}, registry).draft(rs.select(F.lit(c.name).alias("graph_id"), "identifier", "text"))
    if c.base_graph:
        g = g.unionByName(read_graph(spark, c.base_graph, c.name)).dropDuplicates()
    return g, rs


def reasoned(graph: DataFrame, enabled: bool = True) -> tuple[DataFrame, DataFrame]:
    """(expanded graph, report): cleaned and, if enabled, closed under the rules.

    report: graph_id, enabled, consistent (null when disabled), unsatisfiable, backend.
    """
    tidy = keep(clean.cleaned(graph), "clean")
    ids = graph.select("graph_id").dropDuplicates()
    if not enabled:
        none = ids.select("graph_id", F.lit(False).alias("enabled"), F.lit(None).cast("boolean").alias("consistent"), F.lit(0).cast("bigint").alias("unsatisfiable"), F.lit("none").alias("backend"))
        return tidy, none
    closed = keep(closure.owl_rl(tidy), "closed")
    bad = closure.inconsistencies(closed).groupBy("graph_id").agg(F.count_if(F.col("kind") != "unsatisfiable").alias("clashes"), F.count_if(F.col("kind") == "unsatisfiable").alias("unsatisfiable"))
    rep = ids.join(bad, "graph_id", "left").select("graph_id", F.lit(True).alias("enabled"), (F.coalesce("clashes", F.lit(0)) == 0).alias("consistent"), F.coalesce("unsatisfiable", F.lit(0)).alias("unsatisfiable"), F.lit("rules").alias("backend"))
    return closed, rep


def evaluated(spark: SparkSession, graph: DataFrame, c: Config) -> dict[str, DataFrame]:
    """Scores against gold, question answers, drift samples and redundant axioms of a graph."""
    out = {"drift": context.drift_samples(graph, c.base), "redundant": context.redundant_axioms(graph, c.base + "sourceRequirement")}
    if c.gold:
        gold = read_graph(spark, c.gold, c.name)
        out |= {"exact": score.exact(graph, gold), "semantic": score.semantic(graph, gold)}
    if c.questions:
        out["answers"] = Engine(graph).ask(split_queries(_text(c.questions)), {c.prefix: c.base})
    return out


def run(spark: SparkSession, c: Config, rules: Rules = BANKING, registry: dict | None = None) -> dict[str, DataFrame]:
    """All tables of a run: draft, requirements, reasoner, and per policy and threshold the final graph, log and scores."""
    g, rs = draft(spark, c, rules, registry)
    g = keep(g, "draft")
    tables = {"draft": g, "requirements": rs} | {f"draft_{k}": v for k, v in evaluated(spark, g, c).items()}
    if not c.draft_only:
        if not c.shapes:
            raise ValueError("a repair run needs shapes")
        cons, qs = shapes.parse(_text(c.shapes)), split_queries(_text(c.questions) or "")
        for policy in c.policies:
            for threshold in c.thresholds:
                at = policy if len(c.thresholds) == 1 else f"{policy}_{threshold:g}"
                cfg = loop.LoopConfig(base=c.base, policy=policy, max_iterations=c.max_iterations, threshold=threshold, min_patch_iterations=c.min_patch_iterations, prefix=c.prefix, prefixes={c.prefix: c.base}, infer=c.reason)
                final, log = loop.run(g, cons, qs, cfg)
                final = keep(final, "final")
                expanded, rep = reasoned(final, c.reason)
                tables |= {f"{at}_final": final, f"{at}_log": log, f"{at}_reasoner": rep} | {f"{at}_{k}": v for k, v in evaluated(spark, final, c).items()}
                results, answers = loop.evaluate(expanded, final.select("graph_id").dropDuplicates(), cons, qs, infer=False)
                tables |= {f"{at}_results": results, f"{at}_report": report.report_json(final.select("graph_id"), results, answers)}
    if c.output:
        save(tables, c)
    return tables


def save(tables: dict[str, DataFrame], c: Config) -> None:
    """Each table as JSON lines below the output; graphs also as N-Triples."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{c.output}/{c.name}/{name}")
        if set(COLUMNS) <= set(df.columns):
            turtle.ntriples(df).select("line").write.mode("overwrite").text(f"{c.output}/{c.name}/{name}.nt")
            turtle.turtle_lines(df, STANDARD | {c.prefix: c.base}).write.mode("overwrite").text(f"{c.output}/{c.name}/{name}.ttl")
    Path(c.output, c.name).mkdir(parents=True, exist_ok=True)
    Path(c.output, c.name, "config.json").write_text(json.dumps(asdict(c), indent=2), encoding="utf-8")


def summary(tables: dict[str, DataFrame]) -> list[str]:
    """What a run came to, a line per policy: the last iteration of each graph, and the scores there are."""
    out = []
    for name in sorted(n for n in tables if n.endswith("_log")):
        at = name.removesuffix("_log")
        last = tables[name].groupBy("graph_id").agg(F.max_by(F.struct("iteration", "hard", "soft", "cq_pass_rate", "reason"), "iteration").alias("x"))
        row = last.agg(F.count("*").alias("graphs"), F.max("x.iteration").alias("iterations"), F.sum("x.hard").alias("hard"), F.sum("x.soft").alias("soft"), F.avg("x.cq_pass_rate").alias("rate"), F.count_if(F.col("x.hard") == 0).alias("clear")).first()
        out.append(f"{at}: {row.graphs} graphs, {row.clear} without hard results, {row.hard or 0} hard and {row.soft or 0} soft results, pass rate {row.rate or 0:.3f}, up to {row.iterations} iterations")
        for kind in ("exact", "semantic"):
            if f"{at}_{kind}" in tables:
                out += [f"{at}: {kind} precision {r.precision:.4f}, recall {r.recall:.4f}, F1 {r.f1:.4f}" for r in tables[f"{at}_{kind}"].collect()]
    return out


def run_domains(spark: SparkSession, configs: list[Config], **more) -> DataFrame:
    """(domain, policy, iteration.., scores): the logs of several domains, one below the other."""
    logs = []
    for c in configs:
        tables = run(spark, c, **more)
        logs += [v.withColumn("run", F.lit(k.removesuffix("_log"))) for k, v in tables.items() if k.endswith("_log")]
    if not logs:
        return spark.createDataFrame([], "graph_id string, run string")
    return functools.reduce(DataFrame.unionByName, logs)


__all__ = ["Config", "draft", "evaluated", "frame", "load_config", "read_graph", "read_turtle", "reasoned", "run", "run_domains", "save", "summary"]
