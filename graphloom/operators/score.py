"""Precision, recall and F1 of predicted against gold triples, per graph.

Both sides meet in one aggregation by triple; the three counts come from the same shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.model import keyed
from graphloom.operators import closure


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def prf(pred: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """(graph_id, pred, gold, overlap, precision, recall, f1), rounded to 4 places; 0 where nothing is there."""
    both = pred.select("graph_id", *keys, F.lit(1).alias("in_p"), F.lit(0).alias("in_g")).unionByName(gold.select("graph_id", *keys, F.lit(0).alias("in_p"), F.lit(1).alias("in_g")))
    one = both.groupBy("graph_id", *keys).agg(F.max("in_p").alias("in_p"), F.max("in_g").alias("in_g"))
    n = one.groupBy("graph_id").agg(F.sum("in_p").alias("pred"), F.sum("in_g").alias("gold"), F.sum(F.col("in_p") * F.col("in_g")).alias("overlap"))
    p, r = ratio(F.col("overlap"), F.col("pred")), ratio(F.col("overlap"), F.col("gold"))
    return n.select("graph_id", "pred", "gold", "overlap", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(ratio(2 * p * r, p + r), 4).alias("f1"))


def exact(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """By term identity; blank nodes of different parses never match."""
    return prf(keyed(pred), keyed(gold), ["s", "p", "o"])


def norm(c: Column) -> Column:
    """Lower case without underscores, hyphens and blanks."""
    return F.translate(F.lower(c), "_- ", "")


def normalized(graph: DataFrame) -> DataFrame:
    return graph.select("graph_id", *(norm(F.col(c)).alias(c) for c in ("s", "p", "o"))).dropDuplicates()


def semantic(pred: DataFrame, gold: DataFrame, closed: bool = False) -> DataFrame:
    """By normalised terms, of the closures under the OWL-RL subset if ``closed``; each figure is at least the exact one."""
    p, g = (closure.owl_rl(pred), closure.owl_rl(gold)) if closed else (pred, gold)
    s, e = prf(normalized(p), normalized(g), ["s", "p", "o"]), exact(pred, gold)
    best = [F.greatest(f"s.{c}", f"e.{c}").alias(c) for c in ("precision", "recall", "f1")]
    return s.alias("s").join(e.alias("e"), "graph_id").select("graph_id", "s.pred", "s.gold", "s.overlap", *best)


def pass_rate(results: DataFrame, *by: str) -> DataFrame:
    """Share of competency questions passed."""
    return results.groupBy(*by).agg(F.count_if(F.col("success")).alias("passed"), F.count("*").alias("total"), F.round(F.avg(F.col("success").cast("int")), 4).alias("pass_rate"))
