"""The repair loop over many graphs at once.

Each round cleans, validates and questions the graphs still open, turns failures into patches
and merges the patches' triples as a delta. Decisions are columns; the driver learns only how
many graphs are open. Each round's state is written to the shared folder.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.common import keep
from graphloom.functions import text
from graphloom.model import COLUMNS, STANDARD, merged
from graphloom.operators import clean, closure, repair, score, shapes
from graphloom.plans import drafting
from graphloom.plans.drafting import Generator
from graphloom.plans.sparql import Engine
from graphloom.sources import turtle


@dataclass
class LoopConfig:
    base: str
    policy: str = "default"
    max_iterations: int = 3
    threshold: float = 0.8
    min_patch_iterations: int = 0
    prefix: str = "atm"
    prefixes: dict[str, str] = field(default_factory=dict)
    infer: bool = True
    soft_if_no_hard: bool = False

    def __post_init__(self):
        if self.policy not in repair.POLICIES:
            raise ValueError(f"unknown policy {self.policy}")
        if self.max_iterations < 1:
            raise ValueError("max_iterations must be above 0")


def evaluate(graph: DataFrame, graphs: DataFrame, constraints: list[shapes.Constraint], questions: list[str], infer: bool = True) -> tuple[DataFrame, DataFrame]:
    """(validation results, question results) of all graphs; inference is on a copy. A graph with ill-formed decimals has no results."""
    closed = keep(closure.rdfs(graph), "closed") if infer else graph
    results = keep(shapes.validated(constraints, closed)[0], "results") if constraints else graph.sparkSession.createDataFrame([], ", ".join(f"{c} string" for c in shapes.RESULT))
    return results, keep(Engine(graph, graphs).ask(questions), "answers")


def patches_of(results: DataFrame, answers: DataFrame, questions: list[str], c: LoopConfig) -> DataFrame:
    texts = F.broadcast(results.sparkSession.createDataFrame(list(enumerate(questions, 1)), "cq_id int, query string"))  # the question list
    failed = answers.where("not success").join(texts, "cq_id").select("graph_id", "cq_id", "query")
    first = repair.from_results(results, ["graph_id"], ["message", "source_shape"], c.soft_if_no_hard)
    return repair.merged_patches(first, repair.from_questions(failed, c.prefix), ["graph_id"])


def applied(patches: DataFrame, c: LoopConfig, answer: Callable[[DataFrame], DataFrame] | None) -> tuple[DataFrame, DataFrame]:
    """(delta, graphs whose patches came to nothing). A generator answers patches with Turtle texts (graph_id, turtle).

    A text is unfenced and repaired; where it still cannot be parsed, or there is none, the patches are applied by rule. A
    graph for which neither gives a triple has come to an end.
    """
    rules = repair.applied(patches, c.base, c.prefixes)
    if answer is None:
        return rules, patches.sparkSession.createDataFrame([], "graph_id string")
    raw = answer(patches).select(F.col("graph_id").alias("doc"), text.strip_fence(F.col("turtle")).alias("text")).where("text is not null and text <> ''")
    head = "".join(f"@prefix {p}: <{ns}> .\n" for p, ns in (STANDARD | c.prefixes).items())
    fixed = text.repaired(raw).select("doc", F.concat(F.lit(head), "text").alias("text"))
    told = keep(turtle.parse_column(fixed, "doc", "text"), "answers")
    heard = told.select("graph_id").dropDuplicates()
    rules = keep(rules.join(heard, "graph_id", "left_anti"), "rules")
    lost = patches.select("graph_id").dropDuplicates().join(heard, "graph_id", "left_anti").join(rules.select("graph_id"), "graph_id", "left_anti")
    return merged(told, rules), lost


def by_prompts(draft: DataFrame, constraints: list[shapes.Constraint], generator: Generator, most: int = 3, infer: bool = True) -> tuple[DataFrame, DataFrame]:
    """(final triples, log) of the loop in which a generator repairs by prompts: a graph is open until it conforms, for at most ``most`` repairs.

    log: graph_id, iteration, results, conforms.
    """
    now = keep(clean.cleaned(draft.select(*COLUMNS).dropDuplicates()), "draft")
    open_ = keep(now.select("graph_id").dropDuplicates(), "open")
    done, logs = [], []
    for iteration in range(most + 1):
        closed = keep(closure.rdfs(now), "closed") if infer else now
        results, bad = shapes.validated(constraints, closed)
        results = keep(results, "results")
        state = shapes.conforms(results, open_, bad).join(results.groupBy("graph_id").agg(F.count("*").alias("n")), "graph_id", "left")
        state = keep(state.select("graph_id", F.lit(iteration).alias("iteration"), F.coalesce("n", F.lit(0)).alias("results"), "conforms"), "state")
        logs.append(state)
        over = state.where(F.col("conforms") | (F.col("iteration") == most)).select("graph_id")
        done.append(now.join(over, "graph_id", "left_semi"))
        open_ = keep(open_.join(over, "graph_id", "left_anti"), "open")
        if open_.isEmpty():
            break
        prompts = drafting.repair_prompts(results.join(open_, "graph_id", "left_semi")).dropDuplicates()
        asked = prompts.withColumn("idx", F.pmod(F.xxhash64("prompt"), F.lit(2**31)))  # the same prompt has one number in every round
        now = keep(clean.cleaned(merged(now.join(open_, "graph_id", "left_semi"), generator.repair(asked))), "graph")
    return functools.reduce(DataFrame.unionByName, done), functools.reduce(DataFrame.unionByName, logs)


def run(draft: DataFrame, constraints: list[shapes.Constraint], questions: list[str], c: LoopConfig, answer: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(final triples, log). ``answer`` is a generator's call that turns patches into Turtle texts, see ``applied``; a graph
    that it and the rules leave without a triple stops with ``patch_parse_error``.

    log: graph_id, iteration, hard, soft, total, cq_pass_rate, patch_count, triples_before, triples_after, stop, reason."""
    now = keep(draft.select(*COLUMNS).dropDuplicates(), "draft")
    open_ = keep(now.select("graph_id").dropDuplicates().withColumns({"digest": F.lit(None).cast("bigint"), "patched": F.lit(0)}), "open")
    done, logs = [], []
    for iteration in range(c.max_iterations + 1):
        tidy = keep(clean.cleaned(now), "clean")
        results, answers = evaluate(tidy, open_, constraints, questions, c.infer)
        patches = keep(patches_of(results, answers, questions, c), "patches")
        per = patches.groupBy("graph_id").agg(F.count("*").alias("patch_count"), F.bit_xor(F.xxhash64("action", *repair.KEY, F.coalesce("message", F.lit("")))).alias("now_digest"))
        size = lambda g, name: g.groupBy("graph_id").agg(F.count("*").alias(name))
        rate = score.pass_rate(answers, "graph_id").select("graph_id", "pass_rate")
        state = open_.join(shapes.summary(results, "graph_id").drop("total"), "graph_id", "left").join(rate, "graph_id", "left").join(per, "graph_id", "left")
        state = state.join(size(now, "triples_before"), "graph_id", "left").join(size(tidy, "triples_after"), "graph_id", "left")
        state = _state(state)
        cols = {"policy": F.lit(c.policy), "iteration": F.lit(iteration), "most": F.lit(c.max_iterations), "threshold": F.lit(c.threshold), "unchanged": F.coalesce(F.col("digest") == F.col("now_digest"), F.lit(False))}
        state = state.withColumns(cols).withColumn("reason", repair.stop_column("policy", "iteration", "most", "hard", "cq_pass_rate", "threshold", "patch_count", "unchanged"))
        again = (F.col("reason") != "max_iterations_reached") & (F.col("patch_count") > 0) & (F.col("patched") < c.min_patch_iterations) & (F.col("iteration") < c.max_iterations)
        state = keep(state.withColumn("reason", F.when(again, "continue").otherwise(F.col("reason"))).withColumn("stop", F.col("reason") != "continue"), "state")
        delta, lost = applied(patches.join(state.where("not stop").select("graph_id"), "graph_id", "left_semi"), c, answer)
        if answer is not None:
            state = state.join(lost.withColumn("lost", F.lit(True)), "graph_id", "left").withColumn("reason", F.when(F.col("lost"), "patch_parse_error").otherwise(F.col("reason")))
            state = keep(state.withColumn("stop", F.col("stop") | F.coalesce("lost", F.lit(False))).drop("lost"), "state")
        logs.append(state.select("graph_id", "iteration", "hard", "soft", "total", "cq_pass_rate", "patch_count", "triples_before", "triples_after", "stop", "reason"))
        over = state.where("stop").select("graph_id")
        done.append(tidy.join(over, "graph_id", "left_semi"))
        open_ = keep(state.where("not stop").select("graph_id", F.col("now_digest").alias("digest"), (F.col("patched") + 1).alias("patched")), "open")
        if open_.isEmpty():
            break
        go = open_.select("graph_id")
        now = keep(merged(now.join(go, "graph_id", "left_semi"), delta.join(go, "graph_id", "left_semi")), "graph")
    log, final = logs[0], done[0]
    for x in logs[1:]:
        log = log.unionByName(x)
    for x in done[1:]:
        final = final.unionByName(x)
    return final, log


def _state(state: DataFrame) -> DataFrame:
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return state.select("graph_id", "digest", "now_digest", "patched", *(zero(x) for x in ("hard", "soft", "patch_count", "triples_before", "triples_after")), (F.coalesce("hard", F.lit(0)) + F.coalesce("soft", F.lit(0))).alias("total"), F.coalesce("pass_rate", F.lit(0.0)).alias("cq_pass_rate"))
