"""Fixpoints over triples: transitive paths, RDFS and an OWL-RL subset.

A round joins what the round before found with all that is known, drops what is known with an
anti-join, and writes it to the shared folder, so plans stay short and a lost executor costs one
round. Only a count comes back to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.common import keep
from graphloom.model import CLASS, COLUMNS, DOMAIN, OWL, RANGE, RDF, RDFS, SUBCLASS, SUBPROPERTY, TYPE, merged

#: Tables of pairs a round checks against before they are written as one.
PARTS = 6


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def transitive(edges: DataFrame, keys: tuple[str, ...] = ("graph_id",)) -> DataFrame:
    """p+ over edges (keys.., s, o): pairs joined by one step or more; cycles end by themselves.

    The reach doubles: after k rounds all pairs of up to 2**k steps are known, since a round joins
    what the last one found with all that was known before it and with itself. A path of a
    thousand steps takes eleven rounds; there is no most number of them.
    """
    cols = [*keys, "s", "o"]
    new = keep(edges.select(*cols).where("s is not null and o is not null").dropDuplicates(), "edges")
    parts: list[DataFrame] = []
    while not new.isEmpty():
        parts.append(new)
        if len(parts) > PARTS:
            parts = [keep(_together(parts), "reach")]
        known = _together(parts)
        left = new.select(*keys, "s", F.col("o").alias("mid"))
        right = known.select(*keys, F.col("s").alias("mid"), "o")
        # Every longer path splits into a new half and a known one, whichever comes first.
        found = left.join(right, [*keys, "mid"]).select(*cols)
        if len(parts) > 1 or known is not new:
            back = known.select(*keys, "s", F.col("o").alias("mid")).join(new.select(*keys, F.col("s").alias("mid"), "o"), [*keys, "mid"]).select(*cols)
            found = found.unionByName(back)
        found = found.dropDuplicates()
        for p in parts:
            found = found.join(p, cols, "left_anti")
        new = keep(found, "reach")
    return _together(parts) if parts else new


def reflexive(closure: DataFrame, nodes: DataFrame, keys: tuple[str, ...] = ("graph_id",)) -> DataFrame:
    """p*: the closure and each node with itself; nodes (keys.., s)."""
    return closure.unionByName(nodes.select(*keys, "s", F.col("s").alias("o"))).dropDuplicates()


def edges_of(graph: DataFrame, p: str) -> DataFrame:
    return graph.where((F.col("p") == p) & (F.col("o_kind") != "lit")).select("graph_id", "s", "o")


def list_members(graph: DataFrame) -> DataFrame:
    """(graph_id, list, member) of RDF collections, by the path rdf:rest*/rdf:first; ``list`` is any cell, as on that path.

    For the members of whole lists alone see ``whole_lists``, which has a row per member only.
    """
    rest = edges_of(graph, RDF + "rest")
    heads = graph.where(F.col("p") == RDF + "first").select("graph_id", "s").dropDuplicates()
    walk = reflexive(transitive(rest), heads)
    first = graph.where(F.col("p") == RDF + "first").select("graph_id", F.col("s").alias("at"), F.col("o").alias("member"))
    return walk.select("graph_id", F.col("s").alias("list"), F.col("o").alias("at")).join(first, ["graph_id", "at"]).select("graph_id", "list", "member").dropDuplicates()


def whole_lists(graph: DataFrame) -> DataFrame:
    """(graph_id, list, member) with ``list`` the first cell of a collection: a row per member.

    Each cell points to an earlier one, at twice the distance each round, until all point to a
    first cell; a thousand members take ten rounds. Cells on a ring have no first cell and no rows.
    """
    rest = edges_of(graph, RDF + "rest").where(F.col("o") != RDF + "nil").dropDuplicates()
    first = graph.where(F.col("p") == RDF + "first").select("graph_id", F.col("s").alias("at"), F.col("o").alias("member")).dropDuplicates()
    jump = keep(rest.select("graph_id", F.col("o").alias("at"), F.col("s").alias("head")), "cells")
    steps = jump.count()  # no list is longer than the cells that follow another
    span = 1
    while span <= steps:
        up = jump.select("graph_id", F.col("at").alias("head"), F.col("head").alias("further"))
        far = keep(jump.join(up, ["graph_id", "head"], "left").select("graph_id", "at", F.coalesce("further", "head").alias("head"), F.col("further").isNotNull().alias("moved")).dropDuplicates(), "cells")
        jump = far.drop("moved")
        span *= 2
        if far.where("moved").isEmpty():
            break
    inner = jump.select("graph_id", "at").dropDuplicates()
    ends = jump.join(inner.withColumnRenamed("at", "head"), ["graph_id", "head"], "left_anti")
    heads = first.join(inner, ["graph_id", "at"], "left_anti").select("graph_id", "at", F.col("at").alias("head"))
    return ends.select("graph_id", "at", "head").unionByName(heads).join(first, ["graph_id", "at"]).select("graph_id", F.col("head").alias("list"), "member").dropDuplicates()


def _row(df: DataFrame, s: str, p, o: str, o_kind: str = "iri") -> DataFrame:
    return df.select("graph_id", F.col(s).alias("s"), F.when(F.col(s).startswith("_:"), "bnode").otherwise("iri").alias("s_kind"), p.alias("p"), F.col(o).alias("o"),
                     F.when(F.col(o).startswith("_:"), "bnode").otherwise(o_kind).alias("o_kind"), F.lit(None).cast("string").alias("o_dt"), F.lit(None).cast("string").alias("o_lang"))


def rdfs(graph: DataFrame) -> DataFrame:
    """RDFS entailment used by validation: rdfs2, 3, 5, 7, 9 and 11.

    The schema closures are taken once; property, domain, range and type propagation are then
    joins with them, in the one order that needs no further round.
    """
    graph = keep(graph.select(*COLUMNS).dropDuplicates(), "graph")
    sub_p = keep(transitive(edges_of(graph, SUBPROPERTY)), "subproperty")
    sub_c = keep(transitive(edges_of(graph, SUBCLASS)), "subclass")
    up = graph.join(sub_p.select("graph_id", F.col("s").alias("p"), F.col("o").alias("sup")), ["graph_id", "p"]).withColumn("p", F.col("sup")).select(*COLUMNS)  # rdfs7
    full = keep(merged(graph, up), "graph")
    dom = edges_of(full, DOMAIN).select("graph_id", F.col("s").alias("p"), F.col("o").alias("c"))
    ran = edges_of(full, RANGE).select("graph_id", F.col("s").alias("p"), F.col("o").alias("c"))
    typed = F.lit(TYPE)
    by_domain = _row(full.select("graph_id", "s", "p").join(dom, ["graph_id", "p"]), "s", typed, "c")  # rdfs2
    by_range = _row(full.where("o_kind <> 'lit'").select("graph_id", "o", "p").join(ran, ["graph_id", "p"]), "o", typed, "c")  # rdfs3
    types = edges_of(merged(full, by_domain, by_range), TYPE)
    by_class = _row(types.withColumnRenamed("o", "k").join(sub_c.select("graph_id", F.col("s").alias("k"), F.col("o").alias("c")), ["graph_id", "k"]), "s", typed, "c")  # rdfs9
    return merged(full, by_domain, by_range, by_class, _row(sub_c, "s", F.lit(SUBCLASS), "o"), _row(sub_p, "s", F.lit(SUBPROPERTY), "o"))


def owl_rl(graph: DataFrame) -> DataFrame:
    """RDFS and equivalentClass, equivalentProperty, inverseOf, symmetric and transitive properties, to a fixpoint."""
    now = keep(graph.select(*COLUMNS).dropDuplicates(), "graph")
    count = now.count()
    while True:  # triples over given terms are finite and only grow
        eq = []
        for p, q in ((OWL + "equivalentClass", SUBCLASS), (OWL + "equivalentProperty", SUBPROPERTY)):
            e = edges_of(now, p)
            eq += [_row(e, "s", F.lit(q), "o"), _row(e.select("graph_id", F.col("o").alias("s"), F.col("s").alias("o")), "s", F.lit(q), "o")]
        inv = edges_of(now, OWL + "inverseOf")
        inv = inv.unionByName(inv.select("graph_id", F.col("o").alias("s"), F.col("s").alias("o")))
        sym = edges_of(now, TYPE).where(F.col("o") == OWL + "SymmetricProperty").select("graph_id", "s", F.col("s").alias("o"))
        turn = inv.unionByName(sym).select("graph_id", F.col("s").alias("p"), F.col("o").alias("q")).dropDuplicates()
        links = now.where("o_kind <> 'lit'").select("graph_id", "s", "p", "o")
        turned = links.join(turn, ["graph_id", "p"]).select("graph_id", F.col("o").alias("s"), F.col("s").alias("o"), "q")
        tra = edges_of(now, TYPE).where(F.col("o") == OWL + "TransitiveProperty").select("graph_id", F.col("s").alias("p"))
        chains = transitive(links.join(tra, ["graph_id", "p"]).select("graph_id", "p", "s", "o"), ("graph_id", "p"))
        new = keep(rdfs(merged(now, *eq, _row(turned, "s", F.col("q"), "o"), _row(chains, "s", F.col("p"), "o"))), "graph")
        n = new.count()
        if n == count:
            return new
        now, count = new, n


def inconsistencies(closed: DataFrame) -> DataFrame:
    """(graph_id, kind, node): members of disjoint classes or of owl:Nothing, and classes below it."""
    types = edges_of(closed, TYPE)
    dis = edges_of(closed, OWL + "disjointWith")
    clash = dis.select("graph_id", F.col("s").alias("a"), F.col("o").alias("b")).join(types.select("graph_id", "s", F.col("o").alias("a")), ["graph_id", "a"]).join(types.select("graph_id", "s", F.col("o").alias("b")), ["graph_id", "b", "s"])
    nothing = types.where(F.col("o") == OWL + "Nothing")
    unsat = edges_of(closed, SUBCLASS).where(F.col("o") == OWL + "Nothing")
    return (
        clash.select("graph_id", F.lit("disjoint").alias("kind"), F.col("s").alias("node"))
        .unionByName(nothing.select("graph_id", F.lit("nothing").alias("kind"), F.col("s").alias("node")))
        .unionByName(unsat.select("graph_id", F.lit("unsatisfiable").alias("kind"), F.col("s").alias("node")))
        .dropDuplicates()
    )


__all__ = ["CLASS", "RDFS", "edges_of", "inconsistencies", "list_members", "owl_rl", "rdfs", "reflexive", "transitive"]
