"""What is known of a schema, and samples of what is odd in a draft."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import CLASS, DATATYPE_PROPERTY, DOMAIN, LABEL, OBJECT_PROPERTY, OWL, RANGE, RDF, RDFS, TYPE, XSD, qname


def schema_context(graph: DataFrame, prefixes: dict[str, str], base: str | None = None) -> DataFrame:
    """(graph_id, kind, name, domain, range, label) of classes and properties, one pass by subject.

    Of several domains, ranges or labels the smallest stands; none is ``(unspecified)``.
    """
    name = lambda c: qname(F.col(c), prefixes)
    pick = lambda p: F.min(F.when(F.col("p") == p, F.col("o")))
    kinds = {CLASS: "class", OBJECT_PROPERTY: "object", DATATYPE_PROPERTY: "data"}
    g = graph.where(F.col("p").isin(TYPE, DOMAIN, RANGE, LABEL))
    if base is not None:
        g = g.where(F.col("s").startswith(base))
    one = g.groupBy("graph_id", "s").agg(
        F.collect_set(F.when((F.col("p") == TYPE) & F.col("o").isin(*kinds), F.col("o"))).alias("types"), pick(DOMAIN).alias("domain"), pick(RANGE).alias("range"), pick(LABEL).alias("label"))
    kind = F.explode(F.transform("types", lambda t: F.element_at(F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv)), t)))
    return one.select("graph_id", kind.alias("kind"), name("s").alias("name"), "s", "domain", "range", "label").select(
        "graph_id", "kind", "name", *(F.when(F.col("kind") == "class", None).otherwise(F.coalesce(name(c), F.lit("(unspecified)"))).alias(c) for c in ("domain", "range")), "label")


def drift_samples(graph: DataFrame, base: str, limit: int = 10) -> DataFrame:
    """(graph_id, iri): IRIs outside the base and the standard namespaces, the first ``limit`` of each graph by name."""
    from pyspark.sql import Window

    std = (base, RDF, RDFS, OWL, XSD)
    terms = graph.select("graph_id", F.explode(F.array(F.when(F.col("s_kind") == "iri", F.col("s")), F.col("p"), F.when(F.col("o_kind") == "iri", F.col("o")))).alias("iri")).where("iri is not null")
    for ns in std:
        terms = terms.where(~F.col("iri").startswith(ns))
    w = Window.partitionBy("graph_id").orderBy("iri")
    return terms.dropDuplicates().withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit).select("graph_id", "iri")


def redundant_axioms(graph: DataFrame, source_property: str) -> DataFrame:
    """(graph_id, source, axiom): sources that several axioms name, with those axioms."""
    src = graph.where(F.col("p") == source_property).select("graph_id", F.col("o").alias("source"), F.col("s").alias("axiom")).dropDuplicates()
    several = src.groupBy("graph_id", "source").agg(F.count("*").alias("n")).where("n > 1")
    return src.join(several, ["graph_id", "source"]).select("graph_id", "source", "axiom")
