"""Clean-up of asserted graphs: literals, restrictions, class declarations, in this order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.common import keep
from graphloom.functions import literals
from graphloom.model import CLASS, COLUMNS, DATATYPE_PROPERTY, ON_PROPERTY, OWL, RESTRICTION, SUBCLASS, TYPE, XSD, merged

FILLERS = tuple(OWL + x for x in ("someValuesFrom", "allValuesFrom", "hasValue", "minCardinality", "maxCardinality", "cardinality", "minQualifiedCardinality", "maxQualifiedCardinality", "qualifiedCardinality", "onClass", "onDataRange"))


def coerce_literals(graph: DataFrame) -> DataFrame:
    """Ill-formed typed literals lose their type; resources as values of datatype properties become strings.

    Adds ``fixed``. Datatype properties are schema terms; they join by broadcast only through
    Catalyst's own size check.
    """
    props = graph.where((F.col("p") == TYPE) & (F.col("o") == DATATYPE_PROPERTY)).select("graph_id", F.col("s").alias("p"), F.lit(True).alias("data")).dropDuplicates()
    lit = F.col("o_kind") == "lit"
    bad = lit & ~literals.well_formed(F.col("o"), F.coalesce("o_dt", F.lit("")))
    resource = ~lit & F.coalesce("data", F.lit(False))
    g = graph.join(props, ["graph_id", "p"], "left").withColumn("fixed", bad | resource)
    return g.select("graph_id", "s", "s_kind", "p", "o", F.when(resource, "lit").otherwise(F.col("o_kind")).alias("o_kind"), F.when(bad, None).when(resource, XSD + "string").otherwise(F.col("o_dt")).alias("o_dt"), "o_lang", "fixed")


def invalid_restrictions(graph: DataFrame, literal_cardinality_ok: bool = False) -> DataFrame:
    """(graph_id, node): restrictions without exactly one property, without a filler, with a complement, or with a literal filler.

    A literal is right for hasValue; with ``literal_cardinality_ok`` also for cardinalities, where it is the normal form.
    """
    allowed = [OWL + "hasValue"] + ([f for f in FILLERS if "ardinality" in f] if literal_cardinality_ok else [])
    filler = F.col("p").isin(*FILLERS)
    told = ((F.col("p") == TYPE) & (F.col("o") == RESTRICTION)) | F.col("p").isin(ON_PROPERTY, OWL + "complementOf", *FILLERS)
    return (
        graph.where(told).groupBy("graph_id", "s")  # what says nothing of restrictions is never shuffled
        .agg(
            F.max((F.col("p") == TYPE) & (F.col("o") == RESTRICTION)).alias("is_r"), F.count_if(F.col("p") == ON_PROPERTY).alias("n_on"), F.count_if(filler).alias("n_fill"),
            F.max(F.col("p") == OWL + "complementOf").alias("comp"), F.max(filler & (F.col("o_kind") == "lit") & ~F.col("p").isin(*allowed)).alias("lit"),
        )
        .where("is_r and (n_on <> 1 or n_fill = 0 or comp or lit)")
        .select("graph_id", F.col("s").alias("node"))
    )


def strip_restrictions(graph: DataFrame, literal_cardinality_ok: bool = False) -> DataFrame:
    """Without the triples that touch an invalid restriction, at either end."""
    bad = keep(invalid_restrictions(graph, literal_cardinality_ok), "restrictions")
    if bad.isEmpty():
        return graph.select(*COLUMNS)
    # Catalyst broadcasts the invalid nodes where the table written for them is small, and shuffles else.
    out = graph.select(*COLUMNS).join(bad.withColumnRenamed("node", "s"), ["graph_id", "s"], "left_anti")
    # A literal of the same text is no node.
    node = out.withColumn("node", F.when(F.col("o_kind") != "lit", F.col("o")))
    return node.join(bad, ["graph_id", "node"], "left_anti").select(*COLUMNS)


def missing_classes(graph: DataFrame) -> DataFrame:
    """Declarations of undeclared ends of subClassOf, equivalentClass and disjointWith."""
    rel = graph.where(F.col("p").isin(SUBCLASS, OWL + "equivalentClass", OWL + "disjointWith"))
    ends = rel.select("graph_id", F.col("s").alias("s"), F.col("s_kind").alias("s_kind")).unionByName(rel.where("o_kind <> 'lit'").select("graph_id", F.col("o").alias("s"), F.col("o_kind").alias("s_kind"))).dropDuplicates()
    declared = graph.where((F.col("p") == TYPE) & (F.col("o") == CLASS)).select("graph_id", "s")
    none = F.lit(None).cast("string")
    return ends.join(declared, ["graph_id", "s"], "left_anti").select("graph_id", "s", "s_kind", F.lit(TYPE).alias("p"), F.lit(CLASS).alias("o"), F.lit("iri").alias("o_kind"), none.alias("o_dt"), none.alias("o_lang"))


def declare_classes(graph: DataFrame) -> DataFrame:
    return graph.select(*COLUMNS).unionByName(missing_classes(graph))


def cleaned(graph: DataFrame, literal_cardinality_ok: bool = False) -> DataFrame:
    return declare_classes(strip_restrictions(merged(coerce_literals(graph).drop("fixed")), literal_cardinality_ok))
