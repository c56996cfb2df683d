"""Queries of the graph engine over the driver's tables, and their SQL.

The relational tables are mapped to triples (``operators.mapping``); the domain's own tables
(results, patches, responses, requirements, run logs) are used as they are.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.common import keep, pick, spread, table
from graphloom.functions import text as tx
from graphloom.model import CLASS, COLUMNS, DOMAIN, OBJECT_PROPERTY, ON_PROPERTY, OWL, RANGE, RDF, RESTRICTION, SUBCLASS, TYPE, XSD, merged
from graphloom.operators import clean, closure, context, nested, repair, score, shapes
from graphloom.operators.mapping import BASE as B
from graphloom.operators.mapping import TableMap, mapped
from graphloom.plans import drafting, report
from graphloom.plans.sparql import Engine
from graphloom.sources import formats
from graphloom.sources import requirements as req
from graphloom.sources import turtle

REGION = TableMap("region", ("r_regionkey",), {}, ("r_name",))
NATION = TableMap("nation", ("n_nationkey",), {"n_regionkey": "region"}, ("n_name",))
CUSTOMER = TableMap("customer", ("c_custkey",), {"c_nationkey": "nation"}, ("c_mktsegment",))
BALANCES = TableMap("customer", ("c_custkey",), {"c_nationkey": "nation"}, ("c_acctbal",))
ORDERS = TableMap("orders", ("o_orderkey",), {"o_custkey": "customer"}, ("o_orderstatus",))
PARTS = TableMap("part", ("p_partkey",), {}, ("p_size",))


CN, NR, OC, OS, CS, CB = (f"{B}{t}#{c}" for t, c in (("customer", "c_nationkey"), ("nation", "n_regionkey"), ("orders", "o_custkey"), ("orders", "o_orderstatus"), ("customer", "c_mktsegment"), ("customer", "c_acctbal")))


def _geo(s, d) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, (mapped(table(s, d, m.name), m) for m in (REGION, NATION, CUSTOMER)))


def _by_segment(s, d) -> DataFrame:
    """A graph per market segment: customers and their nations."""
    c = table(s, d, "customer")
    seg = c.select(CUSTOMER.subject("c_custkey").alias("s"), F.col("c_mktsegment").alias("graph_id"))
    return mapped(c, CUSTOMER).drop("graph_id").join(seg, "s").select(*COLUMNS)


def _iri(p: str, k) -> F.Column:
    return F.concat(F.lit(f"{B}{p}/"), k.cast("string"))


def _edges(df: DataFrame, s, p: str, o, o_kind="iri", dt=None, graph=None) -> DataFrame:
    none = F.lit(None).cast("string")
    g = F.lit("g") if graph is None else graph
    return df.select(g.alias("graph_id"), s.alias("s"), F.when(s.startswith("_:"), "bnode").otherwise("iri").alias("s_kind"), F.lit(p).alias("p"), o.cast("string").alias("o"),
                     F.lit(o_kind).alias("o_kind") if o_kind != "node" else F.when(o.startswith("_:"), "bnode").otherwise("iri").alias("o_kind"), (F.lit(dt) if dt else none).cast("string").alias("o_dt"), none.alias("o_lang")).where("s is not null and o is not null")


# Triples and patterns -------------------------------------------------------------------------


def direct_mapping(s, d):
    return _geo(s, d).select("s", "p", "o", "o_kind", "o_dt")


def predicate_stats(s, d):
    return _geo(s, d).groupBy("p").agg(F.count("*").alias("n"), F.countDistinct("s").alias("subjects"), F.countDistinct("o").alias("objects"))


def graph_merge(s, d):
    n = mapped(table(s, d, "nation"), NATION)
    return merged(n, n.where(F.col("p") == NR), mapped(table(s, d, "region"), REGION)).groupBy("p").agg(F.count("*").alias("n"))


def bgp_star(s, d):
    q = f'SELECT ?c ?n WHERE {{ ?c a <{B}Customer> ; <{CN}> ?n ; <{CS}> "BUILDING" . }}'
    return Engine(_geo(s, d)).select(q).select("c", "n")


def bgp_chain(s, d):
    q = f"SELECT ?c ?r WHERE {{ ?c <{CN}> ?n . ?n <{NR}> ?r . }}"
    return Engine(_geo(s, d)).select(q).groupBy("r").agg(F.count("*").alias("n"))


GROUND = [f"ASK {{ <{B}customer/{k}> <{CN}> <{B}nation/{n}> }}" for k, n in ((0, 2), (1, 19), (2, 3), (3, 4), (5, 1))]


def _asked(s, d, queries):
    return Engine(_by_segment(s, d)).ask(queries).select("graph_id", "cq_id", "success")


def ground_ask_suite(s, d):
    return _asked(s, d, GROUND)


def bind_exists_or(s, d):
    a, b = (f"EXISTS {{ <{B}customer/{k}> <{CN}> <{B}nation/{n}> ; a <{B}Customer> . }}" for k, n in ((0, 2), (1, 19)))
    return _asked(s, d, [f"ASK {{ BIND({a} AS ?x) BIND({b} AS ?y) FILTER(?x || ?y) }}", f"ASK {{ BIND({a} AS ?x) BIND({b} AS ?y) FILTER(?x && !?y) }}"])


def values_division(s, d):
    def q(lo, hi):
        return f"ASK {{ FILTER NOT EXISTS {{ VALUES ?n {{ {' '.join(f'<{B}nation/{i}>' for i in range(lo, hi))} }} FILTER NOT EXISTS {{ ?c <{CN}> ?n }} }} }}"

    return _asked(s, d, [q(0, 10), q(0, 25), q(20, 30)])


def not_exists(s, d):
    g = mapped(table(s, d, "customer"), CUSTOMER).unionByName(mapped(table(s, d, "orders"), ORDERS))
    q = f'SELECT ?c WHERE {{ ?c a <{B}Customer> . FILTER NOT EXISTS {{ ?o <{OC}> ?c ; <{OS}> "P" . }} }}'
    return Engine(g).select(q).select("c")


def _dated(s, d):
    o = table(s, d, "orders")
    sub = _iri("orders", F.col("o_orderkey"))
    return _edges(o, sub, OC, _iri("customer", F.col("o_custkey"))).unionByName(_edges(o, sub, f"{B}orders#day", F.date_format("o_orderdate", "yyyy-MM-dd"), "lit", XSD + "date")).unionByName(_edges(o, sub, TYPE, F.lit(B + "Orders")))


def double_booking(s, d):
    q = f"SELECT ?a WHERE {{ ?a <{OC}> ?c ; <{B}orders#day> ?t . ?b <{OC}> ?c ; <{B}orders#day> ?t . FILTER(?a != ?b) }}"
    return Engine(_dated(s, d)).select(q).select("a")


def _lists(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")  # the nations of a region
    n = table(s, d, "nation").withColumn("i", F.row_number().over(w)).withColumn("last", F.lead("n_nationkey").over(w).isNull())
    node = lambda k: F.concat(F.lit("_:l"), F.col("n_regionkey").cast("string"), F.lit("_"), k.cast("string"))
    rest = F.when(F.col("last"), RDF + "nil").otherwise(node(F.col("i") + 1))
    return _edges(n, node(F.col("i")), RDF + "first", _iri("nation", F.col("n_nationkey"))).unionByName(_edges(n, node(F.col("i")), RDF + "rest", rest, "node"))


def list_member_path(s, d):
    return closure.list_members(_lists(s, d)).select(F.col("list").alias("head"), "member")


def whole_lists(s, d):
    """Members of whole lists, a row each: the orders of a customer as a list, which grows with the tables."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")  # the orders of a customer
    o = table(s, d, "orders").select("o_custkey", "o_orderkey", F.lead("o_orderkey").over(w).alias("nxt"))
    node = lambda k: F.concat(F.lit("_:o"), k.cast("string"))
    g = _edges(o, node(F.col("o_orderkey")), RDF + "first", _iri("orders", F.col("o_orderkey"))).unionByName(_edges(o, node(F.col("o_orderkey")), RDF + "rest", F.coalesce(node(F.col("nxt")), F.lit(RDF + "nil")), "node"))
    return closure.whole_lists(g).select("list", "member")


def _part_of(s, d):
    c, n = table(s, d, "customer"), table(s, d, "nation")
    return _edges(c, _iri("customer", F.col("c_custkey")), B + "partOf", _iri("nation", F.col("c_nationkey"))).unionByName(_edges(n, _iri("nation", F.col("n_nationkey")), B + "partOf", _iri("region", F.col("n_regionkey"))))


def path_plus(s, d):
    return Engine(_part_of(s, d)).select(f"SELECT ?a ?b WHERE {{ ?a <{B}partOf>+ ?b }}").select("a", "b")


def path_star(s, d):
    return Engine(_part_of(s, d)).select(f"SELECT ?a ?b WHERE {{ ?a <{B}partOf>* ?b }}").select("a", "b")


def path_cycle(s, d):
    n = table(s, d, "nation")
    e = _edges(n, _iri("nation", F.col("n_nationkey")), B + "next", _iri("nation", (F.col("n_nationkey") * 2 + 1) % 25))
    return closure.transitive(closure.edges_of(e, B + "next")).select("s", "o")


def path_inverse_sequence(s, d):
    q = f"SELECT ?a ?b WHERE {{ ?a ^<{NR}>/<{NR}> ?b }}"
    return Engine(mapped(table(s, d, "nation"), NATION)).select(q).select("a", "b")


def optional_union(s, d):
    q = f"SELECT ?n ?r WHERE {{ {{ ?n <{NR}> <{B}region/1> }} UNION {{ ?n <{NR}> <{B}region/2> }} OPTIONAL {{ ?n <{NR}> ?r . FILTER(?r = <{B}region/2>) }} }}"
    return Engine(mapped(table(s, d, "nation"), NATION)).select(q).select("n", "r")


# Inference ------------------------------------------------------------------------------------


def _brands(s, d):
    p = table(s, d, "part")
    brand = F.concat(F.lit(B), F.replace(F.col("p_brand"), F.lit("#"), F.lit("")))
    k = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int")
    kinds = p.select("p_brand").distinct()
    maker = F.concat(F.lit(B + "Maker"), (k % 5).cast("string"))
    return (
        _edges(p, _iri("part", F.col("p_partkey")), TYPE, brand)
        .unionByName(_edges(kinds, brand, SUBCLASS, maker))
        .unionByName(_edges(kinds, maker, SUBCLASS, F.lit(B + "Part")))
        .dropDuplicates()
    )


def rdfs_subclass_types(s, d):
    return shapes.types(_brands(s, d)).groupBy("class").agg(F.count("*").alias("n"))


def rdfs_domain_range(s, d):
    c = table(s, d, "customer")
    links = _edges(c, _iri("customer", F.col("c_custkey")), CN, _iri("nation", F.col("c_nationkey")))
    schema = s.createDataFrame([("g", CN, "iri", p, B + o, "iri", None, None) for p, o in ((DOMAIN, "Customer"), (RANGE, "Nation"))], links.schema)
    g = closure.rdfs(links.unionByName(schema))
    return g.where(F.col("p") == TYPE).groupBy("o").agg(F.count("*").alias("n")).withColumnRenamed("o", "class")


def owl_inverse(s, d):
    n = mapped(table(s, d, "nation"), NATION).where(F.col("p") == NR)
    schema = s.createDataFrame([("g", NR, "iri", OWL + "inverseOf", B + "hasNation", "iri", None, None)], n.schema)
    return closure.owl_rl(n.unionByName(schema)).where(F.col("p") == B + "hasNation").select("s", "o")


# Validation -----------------------------------------------------------------------------------

_SHAPES = {
    "min_count": (f"{B}orders#urgency", False, "minCount", "1", "Violation", "Orders"),
    "max_count": (f"{B}customer#status", False, "maxCount", "2", "Violation", "Customer"),
    "class": (CN, False, "class", B + "EuropeanNation", "Violation", "Customer"),
    "datatype": (f"{B}part#size", False, "datatype", XSD + "integer", "Violation", "Part"),
    "min_inclusive": (CB, False, "minInclusive", "0", "Violation", "Customer"),
    "max_inclusive": (CB, False, "maxInclusive", "9000", "Warning", "Customer"),
    "inverse_path": (OC, True, "minCount", "12", "Violation", "Customer"),
    "unique_key": (f"{OC} {B}orders#day", False, "uniqueKey", "", "Violation", "Orders"),
}


def _constraint(name: str) -> shapes.Constraint:
    path, inverse, comp, arg, severity, target = _SHAPES[name]
    return shapes.Constraint(B + name, B + target, "" if comp == "uniqueKey" else path, inverse, comp, path if comp == "uniqueKey" else arg, severity, f"{name} is broken")


def _shape_graph(s, d, *names: str) -> DataFrame:
    """The triples that the named constraints look at, and no others."""
    c, o, p, n = (table(s, d, t) for t in ("customer", "orders", "part", "nation"))
    ck, ok, pk = _iri("customer", F.col("c_custkey")), _iri("orders", F.col("o_orderkey")), _iri("part", F.col("p_partkey"))
    parts = {
        "min_count": lambda: [_edges(o, ok, f"{B}orders#urgency", F.nullif("o_orderpriority", F.lit("1-URGENT")), "lit", XSD + "string"), _edges(o, ok, TYPE, F.lit(B + "Orders"))],
        "max_count": lambda: [_edges(o, _iri("customer", F.col("o_custkey")), f"{B}customer#status", F.col("o_orderstatus"), "lit", XSD + "string").dropDuplicates(), _edges(c, ck, TYPE, F.lit(B + "Customer"))],
        "class": lambda: [_edges(c, ck, CN, _iri("nation", F.col("c_nationkey"))), _edges(c, ck, TYPE, F.lit(B + "Customer")), _edges(n.where("n_regionkey = 3"), _iri("nation", F.col("n_nationkey")), TYPE, F.lit(B + "EuropeanNation"))],
        "datatype": lambda: [_edges(p, pk, f"{B}part#size", F.when(F.col("p_size") % 10 == 0, "n/a").otherwise(F.col("p_size").cast("string")), "lit", XSD + "integer"), _edges(p, pk, TYPE, F.lit(B + "Part"))],
        "min_inclusive": lambda: [mapped(c, BALANCES)], "max_inclusive": lambda: [mapped(c, BALANCES)],
        "inverse_path": lambda: [mapped(o, ORDERS).where(F.col("p") == OC), _edges(c, ck, TYPE, F.lit(B + "Customer"))],
        "unique_key": lambda: [_dated(s, d)],
    }
    return functools.reduce(DataFrame.unionByName, (x for name in names for x in parts[name]())).dropDuplicates()


def _shacl(name: str):
    def q(s, d):
        r = shapes.Validator([_constraint(name)]).results(_shape_graph(s, d, name))
        return r.select("focus_node", "component", "severity", "message")

    return q


def _all_results(s, d):
    names = ("min_count", "max_count", "class", "datatype", "min_inclusive", "max_inclusive", "inverse_path", "unique_key")
    return shapes.Validator([_constraint(n) for n in names]).results(_shape_graph(s, d, *(n for n in names if n != "max_inclusive")))


def shacl_report(s, d):
    return _all_results(s, d).groupBy("source_shape", "component", "severity").agg(F.count("*").alias("n"))


def shacl_summary(s, d):
    return shapes.summary(_all_results(s, d))


def shacl_conforms(s, d):
    c = table(s, d, "customer")
    seg = c.select(CUSTOMER.subject("c_custkey").alias("s"), F.col("c_mktsegment").alias("graph_id"))
    g = mapped(c, BALANCES).drop("graph_id").join(seg, "s").select(*COLUMNS)
    limit = shapes.Constraint(B + "floor", B + "Customer", CB, False, "minInclusive", "-999", "Violation", "floor")
    return shapes.conforms(shapes.Validator([limit]).results(g), g.select("graph_id"))


def results_summary(s, d):
    v = table(s, d, "validation_results").dropDuplicates(["result_id"])
    return shapes.summary(v, "graph_id", "iteration")


# Clean-up -------------------------------------------------------------------------------------


def literal_coerce(s, d):
    g = _shape_graph(s, d, "datatype")
    data = s.createDataFrame([("g", f"{B}part#link", "iri", TYPE, OWL + "DatatypeProperty", "iri", None, None)], g.schema)
    links = _edges(table(s, d, "part"), _iri("part", F.col("p_partkey")), f"{B}part#link", _iri("size", F.col("p_size")))
    return clean.coerce_literals(g.unionByName(data).unionByName(links)).groupBy("p", "o_kind", "o_dt", "fixed").agg(F.count("*").alias("n"))


def _restrictions(s, d):
    """A restriction per order, broken by the last digit of its key: 1 no property, 2 two, 3 no filler, 4 a literal filler, 5 a complement."""
    o = table(s, d, "orders").withColumn("k", F.col("o_orderkey") % 10)
    n = F.concat(F.lit("_:r"), F.col("o_orderkey").cast("string"))
    prop = lambda x: F.lit(f"{B}p{x}")
    return functools.reduce(DataFrame.unionByName, [
        _edges(o, n, TYPE, F.lit(RESTRICTION)), _edges(o.where("k <> 1"), n, ON_PROPERTY, prop(1)), _edges(o.where("k = 2"), n, ON_PROPERTY, prop(2)),
        _edges(o.where("k not in (3, 4)"), n, OWL + "someValuesFrom", F.lit(B + "Filler")), _edges(o.where("k = 4"), n, OWL + "someValuesFrom", F.lit("x"), "lit", XSD + "string"),
        _edges(o.where("k = 5"), n, OWL + "complementOf", F.lit(B + "Other")), _edges(o.where("k = 6"), n, OWL + "hasValue", F.lit("v"), "lit", XSD + "string"),
        _edges(o, _iri("orders", F.col("o_orderkey")), SUBCLASS, n, "node"),
    ])


def restriction_strip(s, d):
    return clean.strip_restrictions(_restrictions(s, d)).groupBy("p").agg(F.count("*").alias("n"))


def declare_missing_classes(s, d):
    g = _brands(s, d)
    some = g.where(F.col("p") == SUBCLASS).select("graph_id", "s").distinct().where(F.col("s").endswith("1"))
    known = _edges(some, F.col("s"), TYPE, F.lit(CLASS))
    return clean.missing_classes(g.unionByName(known)).select("s")


def invalid_decimals(s, d):
    p = table(s, d, "part")
    g = _edges(p, _iri("part", F.col("p_partkey")), f"{B}part#d", F.concat(F.col("p_size").cast("string"), F.when(F.col("p_size") % 7 == 0, ",5").otherwise(".5")), "lit", XSD + "decimal")
    return shapes.bad_decimals(g).select("s", "o")


def clean_pipeline(s, d):
    return clean.cleaned(_restrictions(s, d)).groupBy("p").agg(F.count("*").alias("n"))


# Scores ---------------------------------------------------------------------------------------


def _pair(s, d):
    c = table(s, d, "customer")
    seg = F.col("c_mktsegment")
    link = lambda df, o: _edges(df, _iri("customer", F.col("c_custkey")), CN, o, graph=seg)
    odd = F.when(F.col("c_custkey") % 5 == 0, F.upper(_iri("nation", F.col("c_nationkey")))).otherwise(_iri("nation", F.col("c_nationkey")))
    return link(c.where("c_custkey % 3 <> 0"), odd), link(c.where("c_custkey % 2 = 0"), _iri("nation", F.col("c_nationkey")))


def exact_prf(s, d):
    return score.exact(*_pair(s, d))


def normalized_prf(s, d):
    p, g = _pair(s, d)
    return score.prf(score.normalized(p), score.normalized(g), ["s", "p", "o"])


def semantic_prf(s, d):
    return score.semantic(*_pair(s, d))


def cq_pass_rate(s, d):
    answers = nested.run_tables(table(s, d, "run_logs"))["cq_results"]
    return score.pass_rate(answers.withColumn("success", F.coalesce("success", F.lit(False))), "log_id", "iter_pos")


def iteration_summary(s, d):
    t = nested.run_tables(table(s, d, "run_logs"))
    v = t["violations"].groupBy("log_id", "iter_pos").agg(F.sum(F.when(F.col("name") == "hard", F.col("n"))).alias("hard"), F.sum(F.when(F.col("name") == "soft", F.col("n"))).alias("soft"))
    return t["iterations"].select("log_id", "iter_pos", "stop").join(v, ["log_id", "iter_pos"], "left")


# Text -----------------------------------------------------------------------------------------


def slugify(s, d):
    return table(s, d, "requirements").select("req_id", tx.slug(F.coalesce("title", F.lit(""))).alias("slug"))


def fr_identifier(s, d):
    r = pick(table(s, d, "requirements"), "req_id", "title", "ord")
    src = r.select("req_id", "ord", "title", *(F.lit(None).cast("string").alias(c) for c in ("id", "sentence_id", "identifier")), F.struct(F.lit(None).cast("string").alias("title")).alias("meta"))
    return src.select("req_id", req.identifier(src).alias("identifier"))


def code_fence(s, d):
    return table(s, d, "llm_responses").select("response_id", tx.strip_fence(F.col("turtle")).alias("turtle"))


def prefix_normalize(s, d):
    base = "http://bnk.example.org/onto#"
    return table(s, d, "llm_responses").where("turtle is not null").select("response_id", tx.normalize_prefix(F.col("turtle"), "bnk", base).alias("turtle"))


def prefix_ensure(s, d):
    return table(s, d, "llm_responses").where("turtle is not null").select("response_id", tx.ensure_prefixes(F.col("turtle")).alias("turtle"))


def line_sanitize(s, d):
    """The responses, spoiled in known ways by line, and repaired."""
    src = table(s, d, "llm_responses").where("turtle is not null").select(F.col("response_id").alias("doc"), F.posexplode(F.split("turtle", "\n")).alias("line_no", "text"))
    k = F.pmod(F.col("doc") + F.col("line_no"), F.lit(5))
    bad = F.when(k == 1, F.replace(F.col("text"), F.lit("bnk:"), F.lit("?bnk:"))).when(k == 2, F.concat(F.lit("NOT "), F.col("text"))).when(k == 3, F.concat(F.col("text"), F.lit(" -> x"))).otherwise(F.col("text"))
    return tx.repaired_lines(src.withColumn("text", bad))


def boilerplate(s, d):
    return table(s, d, "requirements").select("req_id", tx.boilerplate(F.col("boilerplate_prefix"), F.col("boilerplate_main"), F.col("boilerplate_suffix")).alias("boilerplate"))


def heuristic_draft(s, d):
    r = pick(table(s, d, "requirements"), "project_id", "identifier", "text").select(F.coalesce("project_id", F.lit("none")).alias("graph_id"), "identifier", "text")
    g = drafting.RuleGenerator(tx.BANKING, "http://bnk.example.org/ns#").draft(r)
    return g.groupBy("graph_id", "p").agg(F.count("*").alias("n"))


def chunk_batches(s, d):
    r = table(s, d, "requirements").select("req_id", F.col("req_id").alias("ord"))
    return req.batches(r, 5).groupBy("batch").agg(F.count("*").alias("n"), F.min("req_id").alias("first_id"))


def split_assign(s, d):
    r = table(s, d, "requirements").select("req_id", "identifier")
    lists = {n: table(s, d, "requirements").where(F.lower(F.trim("split")) == n).select("identifier").where("identifier is not null").distinct() for n in ("dev", "test")}
    return req.assigned(r, lists).select("req_id", "split")


def unmatched_ids(s, d):
    ids = s.createDataFrame([(f"FR-{i}",) for i in range(0, 120, 3)], "identifier string")
    return req.unmatched(table(s, d, "requirements"), ids)


def exemplar_topk(s, d):
    r = table(s, d, "requirements").select("req_id", "identifier", F.lower(F.trim("split")).alias("split"), F.col("req_id").alias("ord"))
    return req.exemplars(r, "dev", 6).select("req_id", "identifier")


def schema_context(s, d):
    c = table(s, d, "nation").select(F.col("n_nationkey").alias("k"))
    prop = F.concat(F.lit(B + "prop"), F.col("k").cast("string"))
    g = functools.reduce(DataFrame.unionByName, [
        _edges(c, prop, TYPE, F.when(F.col("k") % 2 == 0, OBJECT_PROPERTY).otherwise(OWL + "DatatypeProperty")), _edges(c.where("k % 3 <> 0"), prop, DOMAIN, F.concat(F.lit(B + "C"), (F.col("k") % 4).cast("string"))),
        _edges(c.where("k % 5 <> 0"), prop, RANGE, F.concat(F.lit(XSD), F.lit("string"))), _edges(c.where("k < 4"), F.concat(F.lit(B + "C"), F.col("k").cast("string")), TYPE, F.lit(CLASS)),
    ])
    return context.schema_context(g, {"d": B, "xsd": XSD}).select("kind", "name", "domain", "range")


def drift_samples(s, d):
    return context.drift_samples(_geo(s, d), B + "customer", 10).select("iri")


def redundant_axioms(s, d):
    r = table(s, d, "requirements")
    g = _edges(r, F.concat(F.lit(B + "ax"), F.col("req_id").cast("string")), B + "source", F.col("identifier"), "lit", XSD + "string")
    return context.redundant_axioms(g, B + "source").groupBy("source").agg(F.count("*").alias("n"))


# Repair ---------------------------------------------------------------------------------------


def shacl_patches(s, d):
    return repair.from_results(table(s, d, "validation_results"), ["graph_id", "iteration"], ["result_id"])


def shacl_patches_soft(s, d):
    return repair.from_results(table(s, d, "validation_results"), ["graph_id", "iteration"], ["result_id"], True).groupBy("graph_id", "iteration").agg(F.count("*").alias("n"))


def _failed(s, d):
    t = nested.run_tables(table(s, d, "run_logs"))["cq_results"].where("not coalesce(success, false) and query is not null")
    return t.select(F.concat_ws("/", F.col("log_id").cast("string"), F.col("iter_pos").cast("string")).alias("graph_id"), F.col("cq_pos").cast("int").alias("cq_id"), "query")


def cq_patches(s, d):
    return repair.from_questions(_failed(s, d), "bnk")


def merge_patches(s, d):
    p = table(s, d, "patches").where("subject is not null and predicate is not null and object is not null").select("patch_id", "graph_id", "action", *repair.KEY)
    first, then = p.where("action = 'addProperty'").drop("patch_id").distinct(), p.where("action <> 'addProperty'").drop("patch_id").distinct()
    return repair.merged_patches(first, then, ["graph_id"]).groupBy("graph_id", "part").agg(F.count("*").alias("n"))


def patched_triples(s, d):
    """Triples that all patches ask for, of every predicate."""
    ns = {"bnk": "http://bnk.example.org/ns#", "cln": "http://cln.example.org/ns#"}
    t = repair.applied(table(s, d, "patches"), "http://bnk.example.org/ns#", ns)
    return t.groupBy("graph_id", "p", "o_kind").agg(F.count("*").alias("n"))


def apply_patches(s, d):
    """Of these, the predicates of the schema."""
    return patched_triples(s, d).where(F.col("p").isin(SUBCLASS, DOMAIN, RANGE, TYPE))


def patch_type_counts(s, d):
    return repair.type_counts(pick(table(s, d, "patches"), "patch_id", "graph_id", "iteration", "action").dropDuplicates(["patch_id"]), "graph_id", "iteration")


def stop_policy_matrix(s, d):
    flags = s.range(0, 48).select((F.col("id") % 3).cast("int").alias("iteration"), (F.floor(F.col("id") / 3) % 2).cast("int").alias("hard"), (F.floor(F.col("id") / 6) % 2).alias("b"), (F.floor(F.col("id") / 12) % 2).cast("int").alias("n_patches"), (F.floor(F.col("id") / 24) % 2 == 1).alias("unchanged"))
    m = flags.withColumn("policy", F.explode(F.array(*(F.lit(p) for p in repair.POLICIES)))).select("policy", "iteration", F.lit(2).alias("most"), "hard", F.when(F.col("b") == 1, 0.9).otherwise(0.5).alias("rate"), F.lit(0.8).alias("threshold"), "n_patches", "unchanged")
    return m.select("policy", "iteration", "hard", "n_patches", "unchanged", F.col("rate").alias("pass_rate"), repair.stop_column("policy", "iteration", "most", "hard", "rate", "threshold", "n_patches", "unchanged").alias("reason"))


def token_usage(s, d):
    """Tokens that the generator reports, by graph."""
    t = lambda k: F.sum(F.try_element_at("tokens", F.lit(k)).cast("bigint"))
    return table(s, d, "llm_responses").groupBy("graph_id").agg(F.count("*").alias("responses"), t("prompt_tokens").alias("prompt_tokens"), t("completion_tokens").alias("completion_tokens"))


def repair_prompts(s, d):
    v = pick(table(s, d, "validation_results"), "graph_id", "message", "path", "focus_node")
    return drafting.repair_prompts(v).dropDuplicates()


def draft_prompts(s, d):
    """A prompt per batch of five requirements, in order."""
    r = pick(table(s, d, "requirements"), "req_id", "identifier", "text").select(F.col("req_id").alias("ord"), F.coalesce("identifier", F.lit("-")).alias("identifier"), F.coalesce("text", F.lit("")).alias("text"))
    return drafting.draft_prompt(req.batches(r, 5), "- class d:Bank", "- none").select("batch", "prompt")


def _nation_graph(s, d):
    return mapped(table(s, d, "nation"), NATION).unionByName(mapped(table(s, d, "region"), REGION))


def turtle_parse(s, d):
    """Statements of the responses that the Turtle parser reads as a whole."""
    r = table(s, d, "llm_responses").where("turtle is not null").select(F.col("response_id").cast("string").alias("g"), F.concat(F.lit("@prefix bnk: <http://bnk.example.org/ns#> . @prefix cln: <http://cln.example.org/ns#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .\n"), tx.strip_fence(F.col("turtle"))).alias("t"))
    return turtle.parse_column(r, "g", "t").groupBy("p").agg(F.count("*").alias("n"))


def ntriples_roundtrip(s, d):
    return turtle.read_ntriples(turtle.ntriples(_nation_graph(s, d)).select(F.col("line").alias("value"))).select("s", "p", "o", "o_kind")


def ntriples_roundtrip_geo(s, d):
    """The same of a graph that grows with the tables."""
    return turtle.read_ntriples(turtle.ntriples(_geo(s, d)).select(F.col("line").alias("value"))).select("s", "p", "o", "o_kind")


def rdfxml_parse(s, d):
    """A document of RDF/XML per customer, parsed."""
    doc = F.concat(F.lit(f'<rdf:RDF xmlns:rdf="{RDF}" xmlns:d="{B}"><d:Customer rdf:about="{B}customer/'), F.col("c_custkey").cast("string"), F.lit('"><d:segment>'), "c_mktsegment", F.lit(f'</d:segment><d:balance rdf:datatype="{XSD}double">'), F.col("c_acctbal").cast("string"),
                   F.lit(f'</d:balance><d:nation rdf:resource="{B}nation/'), F.col("c_nationkey").cast("string"), F.lit('"/></d:Customer></rdf:RDF>'))
    c = spread(table(s, d, "customer")).select(F.col("c_custkey").cast("string").alias("g"), doc.alias("t"))
    return formats.parse_column(c, "g", "t", "xml").where(F.col("p") != f"{B}balance").select("s", "p", "o", "o_kind")


def report_graph(s, d):
    """The delivered results as report graphs: statements by predicate."""
    v = pick(table(s, d, "validation_results"), "result_id", "graph_id", "focus_node", "path", "message", "severity", "source_shape", "constraint_component", "value").dropDuplicates(["result_id"]).withColumnRenamed("constraint_component", "component")
    return report.report_graph(v.select("graph_id").where("graph_id is not null"), v.drop("result_id")).groupBy("graph_id", "p").agg(F.count("*").alias("n"))


def prompt_loop(s, d):
    """The loop by prompts over a graph per market segment: no rule adds what the shape asks for, so it ends after its repairs."""
    from graphloom.plans import loop

    c = [shapes.Constraint(B + "CustomerShape", B + "Customer", f"{B}customer#contact", False, "minCount", "1", "Violation", "a contact")]
    gen = drafting.RuleGenerator(tx.BANKING, "http://bnk.example.org/ns#")
    return loop.by_prompts(_by_segment(s, d).where("graph_id is not null"), c, gen, most=1, infer=False)[1]


def report_json(s, d):
    v = pick(table(s, d, "validation_results"), "result_id", "graph_id", "focus_node", "path", "message", "severity", "source_shape", "constraint_component", "value").dropDuplicates(["result_id"]).withColumnRenamed("constraint_component", "component")
    answers = s.createDataFrame([], "graph_id string, cq_id int, success boolean, message string")
    return report.report_json(v.select("graph_id").where("graph_id is not null"), v, answers)


def repair_loop(s, d):
    from graphloom.plans import loop

    n = _nation_graph(s, d)
    q = [f"ASK {{ bnk:hasCapital rdfs:domain <{B}Nation> }}", "PREFIX bnk: <http://bnk.example.org/ns#> PREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#> ASK { bnk:hasCapital rdfs:domain bnk:Nation ; rdfs:range bnk:City }"]
    c = [shapes.Constraint(B + "NationShape", B + "Nation", NR, False, "minCount", "2", "Violation", "two regions"), shapes.Constraint(B + "RegionShape", B + "Region", f"{B}region#r_name", False, "minCount", "1", "Violation", "a name")]
    _, log = loop.run(n, c, q[1:], loop.LoopConfig(base="http://bnk.example.org/ns#", policy="hard_and_cq", prefix="bnk", prefixes={"bnk": "http://bnk.example.org/ns#"}, max_iterations=2, infer=False))
    return log


def repair_loop_segments(s, d):
    """The loop over a graph per market segment, with inference and several questions."""
    from graphloom.plans import loop

    g = _by_segment(s, d).where("graph_id is not null")
    ask = "PREFIX bnk: <http://bnk.example.org/ns#> PREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#> ASK "
    q = [ask + "{ bnk:hasCapital rdfs:domain bnk:Nation ; rdfs:range bnk:City }", ask + "{ bnk:hasBranch rdfs:domain bnk:Bank }", ask + f"{{ ?c <{CN}> ?n }}"]
    c = [shapes.Constraint(B + "CustomerShape", B + "Customer", f"{B}customer#contact", False, "minCount", "1", "Violation", "a contact"), shapes.Constraint(B + "CustomerShape", B + "Customer", CN, False, "minCount", "1", "Violation", "a nation")]
    _, log = loop.run(g, c, q, loop.LoopConfig(base="http://bnk.example.org/ns#", policy="hard_and_cq", prefix="bnk", prefixes={"bnk": "http://bnk.example.org/ns#"}, max_iterations=2))
    return log


QUERIES = {
    f.__name__: f
    for f in (
        direct_mapping, predicate_stats, graph_merge, bgp_star, bgp_chain, ground_ask_suite, bind_exists_or, values_division, not_exists, double_booking, list_member_path, path_plus, path_star, path_cycle, path_inverse_sequence, optional_union,
        rdfs_subclass_types, rdfs_domain_range, owl_inverse, shacl_report, shacl_summary, shacl_conforms, results_summary, literal_coerce, restriction_strip, declare_missing_classes, invalid_decimals, clean_pipeline, exact_prf, normalized_prf, semantic_prf,
        cq_pass_rate, iteration_summary, slugify, fr_identifier, code_fence, prefix_normalize, prefix_ensure, line_sanitize, boilerplate, heuristic_draft, chunk_batches, split_assign, unmatched_ids, exemplar_topk, schema_context, drift_samples, redundant_axioms,
        shacl_patches, shacl_patches_soft, cq_patches, merge_patches, apply_patches, patched_triples, patch_type_counts, stop_policy_matrix, token_usage, repair_prompts, draft_prompts, turtle_parse, rdfxml_parse, report_graph, prompt_loop, whole_lists, ntriples_roundtrip, ntriples_roundtrip_geo, report_json, repair_loop, repair_loop_segments,
    )
} | {f"shacl_{n}": _shacl(n) for n in _SHAPES}

from graphloom.queries_graph_sql import SQL  # noqa: E402

__all__ = ["QUERIES", "SQL", "keep"]
