"""The triple model: canonical columns, namespaces and terms.

A graph is a set of rows (graph_id, s, s_kind, p, o, o_kind, o_dt, o_lang); ``graph_id`` lets
many graphs be worked on in one job. IRIs stand expanded, blank nodes as ``_:<graph>_<n>``,
literals keep their lexical form. A *term key* is one string for a term: the IRI, the blank
node, or the literal in quotes with its type or language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("graph_id", "s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang")
SCHEMA = ", ".join(f"{c} string" for c in COLUMNS)

# The W3C namespaces.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
SH = "http://www.w3.org/ns/shacl#"
STANDARD = {"rdf": RDF, "rdfs": RDFS, "owl": OWL, "xsd": XSD}

TYPE = RDF + "type"
SUBCLASS, SUBPROPERTY, DOMAIN, RANGE, LABEL, COMMENT = (RDFS + x for x in ("subClassOf", "subPropertyOf", "domain", "range", "label", "comment"))
CLASS, OBJECT_PROPERTY, DATATYPE_PROPERTY, RESTRICTION, ON_PROPERTY = (OWL + x for x in ("Class", "ObjectProperty", "DatatypeProperty", "Restriction", "onProperty"))


def frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA)


def triples(df: DataFrame, s: Column, p: Column, o: Column, o_kind: str = "iri", o_dt: str | None = None, graph: str | Column = "g") -> DataFrame:
    """Canonical rows from columns of any table."""
    return df.select(
        (graph if isinstance(graph, Column) else F.lit(graph)).alias("graph_id"), s.alias("s"), F.lit("iri").alias("s_kind"), p.alias("p"), o.cast("string").alias("o"),
        F.lit(o_kind).alias("o_kind"), F.lit(o_dt).cast("string").alias("o_dt"), F.lit(None).cast("string").alias("o_lang"),
    ).where("s is not null and o is not null")


def merged(*graphs: DataFrame) -> DataFrame:
    """Union with set semantics."""
    out = graphs[0].select(*COLUMNS)
    for g in graphs[1:]:
        out = out.unionByName(g.select(*COLUMNS))
    return out.dropDuplicates()


def object_key() -> Column:
    tail = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang")).when(F.col("o_dt").isNotNull() & (F.col("o_dt") != XSD + "string"), F.concat(F.lit("^^"), "o_dt")).otherwise("")
    return F.when(F.col("o_kind") == "lit", F.concat(F.lit('"'), "o", F.lit('"'), tail)).otherwise(F.col("o"))


def keyed(graph: DataFrame) -> DataFrame:
    """(graph_id, s, p, o) by term keys, as a set."""
    return graph.select("graph_id", "s", "p", object_key().alias("o")).dropDuplicates()


def literal_key(lex: str, dt: str | None = None, lang: str | None = None) -> str:
    return f'"{lex}"' + (f"@{lang}" if lang else f"^^{dt}" if dt and dt != XSD + "string" else "")


def normalize_base(ns: str) -> str:
    return ns.rstrip("#/") + "#"


def qname(iri: Column, prefixes: dict[str, str]) -> Column:
    """prefix:local by the longest matching namespace, else the IRI in brackets."""
    out = F.concat(F.lit("<"), iri, F.lit(">"))
    for p, ns in sorted(prefixes.items(), key=lambda x: (len(x[1]), x[0])):
        out = F.when(iri.startswith(ns), F.concat(F.lit(p + ":"), F.substring(iri, F.lit(len(ns) + 1), F.length(iri)))).otherwise(out)
    return out


def expand(value: Column, prefixes: dict[str, str], base: str) -> Column:
    """An IRI as it is, a bound prefix expanded, anything else below the base."""
    out = F.concat(F.lit(base), value)
    for p, ns in prefixes.items():
        out = F.when(value.startswith(p + ":"), F.concat(F.lit(ns), F.substring(value, F.lit(len(p) + 2), F.length(value)))).otherwise(out)
    return F.when(value.startswith("http"), value).otherwise(out)
