"""SQL of the graph queries, over the same tables."""

from __future__ import annotations

B = "http://data.example.org/"
RDF, RDFS, OWL, XSD = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#", "http://www.w3.org/2001/XMLSchema#"
TYPE = RDF + "type"
FOR = "http://bnk.example.org/ns#"

_NATION = f"""SELECT '{B}nation/' || n_nationkey AS s, '{TYPE}' AS p, '{B}Nation' AS o, 'iri' AS o_kind, CAST(NULL AS VARCHAR) AS o_dt FROM nation
UNION ALL SELECT '{B}nation/' || n_nationkey, '{B}nation#n_regionkey', '{B}region/' || n_regionkey, 'iri', NULL FROM nation
UNION ALL SELECT '{B}nation/' || n_nationkey, '{B}nation#n_name', n_name, 'lit', '{XSD}string' FROM nation WHERE n_name IS NOT NULL"""
_REGION = f"""SELECT '{B}region/' || r_regionkey AS s, '{TYPE}' AS p, '{B}Region' AS o, 'iri' AS o_kind, CAST(NULL AS VARCHAR) AS o_dt FROM region
UNION ALL SELECT '{B}region/' || r_regionkey, '{B}region#r_name', r_name, 'lit', '{XSD}string' FROM region"""
_GEO = f"""WITH t AS ({_REGION} UNION ALL {_NATION}
UNION ALL SELECT '{B}customer/' || c_custkey, '{TYPE}', '{B}Customer', 'iri', NULL FROM customer
UNION ALL SELECT '{B}customer/' || c_custkey, '{B}customer#c_nationkey', '{B}nation/' || c_nationkey, 'iri', NULL FROM customer
UNION ALL SELECT '{B}customer/' || c_custkey, '{B}customer#c_mktsegment', c_mktsegment, 'lit', '{XSD}string' FROM customer WHERE c_mktsegment IS NOT NULL)
"""
_SEG = "WITH g AS (SELECT DISTINCT c_mktsegment AS graph_id FROM customer WHERE c_mktsegment IS NOT NULL) "


def _asks(conditions: list[str]) -> str:
    return _SEG + " UNION ALL ".join(f"SELECT graph_id, {i} AS cq_id, {c} AS success FROM g" for i, c in enumerate(conditions, 1))


def _has(k: int, n: int) -> str:
    return f"EXISTS (SELECT 1 FROM customer c WHERE c.c_mktsegment = g.graph_id AND c_custkey = {k} AND c_nationkey = {n})"


def _covers(lo: int, hi: int) -> str:
    return f"(SELECT count(DISTINCT c_nationkey) FROM customer c WHERE c.c_mktsegment = g.graph_id AND c_nationkey >= {lo} AND c_nationkey < {hi}) = {hi - lo}"


def _result(rows: str, focus: str, component: str, name: str, severity: str = "Violation") -> str:
    return f"SELECT '{B}' || {focus} AS focus_node, 'sh:{component}ConstraintComponent' AS component, '{severity}' AS severity, '{name} is broken' AS message FROM {rows}"


_SHACL = {
    "min_count": _result("orders WHERE o_orderpriority IS NULL OR o_orderpriority = '1-URGENT'", "'orders/' || o_orderkey", "MinCount", "min_count"),
    "max_count": _result("(SELECT o_custkey FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 2)", "'customer/' || o_custkey", "MaxCount", "max_count"),
    "class": _result("customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey = 3 WHERE c_nationkey IS NOT NULL AND n_nationkey IS NULL", "'customer/' || c_custkey", "Class", "class"),
    "datatype": _result("part WHERE p_size % 10 = 0", "'part/' || p_partkey", "Datatype", "datatype"),
    "min_inclusive": _result("customer WHERE c_acctbal < 0", "'customer/' || c_custkey", "MinInclusive", "min_inclusive"),
    "max_inclusive": _result("customer WHERE c_acctbal > 9000", "'customer/' || c_custkey", "MaxInclusive", "max_inclusive", "Warning"),
    "inverse_path": _result("(SELECT c_custkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING count(o_orderkey) < 12)", "'customer/' || c_custkey", "MinCount", "inverse_path"),
    "unique_key": _result("(SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE)) AS n FROM orders) WHERE n > 1", "'orders/' || o_orderkey", "UniqueKey", "unique_key"),
}
_ALL = "WITH r AS (" + " UNION ALL ".join(f"SELECT '{B}{n}' AS source_shape, * FROM ({q}) AS x{i}" for i, (n, q) in enumerate(_SHACL.items())) + ") "

_PRF = """, k AS (SELECT graph_id, s, o, max(p) AS in_p, max(g) AS in_g FROM (SELECT graph_id, {s} AS s, {o} AS o, 1 AS p, 0 AS g FROM pr UNION ALL SELECT graph_id, {s}, {o}, 0, 1 FROM go) GROUP BY 1, 2, 3),
n AS (SELECT graph_id, CAST(sum(in_p) AS BIGINT) AS pred, CAST(sum(in_g) AS BIGINT) AS gold, CAST(sum(in_p * in_g) AS BIGINT) AS overlap FROM k GROUP BY 1),
r AS (SELECT *, CASE WHEN pred > 0 THEN overlap / pred ELSE 0 END AS p, CASE WHEN gold > 0 THEN overlap / gold ELSE 0 END AS r FROM n)"""
_PAIR = f"""WITH pr AS (SELECT c_mktsegment AS graph_id, '{B}customer/' || c_custkey AS s, CASE WHEN c_custkey % 5 = 0 THEN upper('{B}nation/' || c_nationkey) ELSE '{B}nation/' || c_nationkey END AS o FROM customer WHERE c_custkey % 3 <> 0),
go AS (SELECT c_mktsegment AS graph_id, '{B}customer/' || c_custkey AS s, '{B}nation/' || c_nationkey AS o FROM customer WHERE c_custkey % 2 = 0)"""
_N = "translate(lower({}), '_- ', '')"
_OUT = "SELECT graph_id, pred, gold, overlap, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1 FROM r"
_NORM = _PRF.format(s=_N.format("s"), o=_N.format("o"))

from graphloom.queries_data import _ITS  # noqa: E402

_SLUG = "trim(regexp_replace(coalesce(title, ''), '[^A-Za-z0-9]+', '_', 'g'), '_')"
_FR = "regexp_extract(title, '(?i)(?:functional\\s+requirement|fr)[\\s_-]*([0-9]+)', 1)"
_RULE = {
    "s": "CASE WHEN contains(lower(t), 'customer') THEN 'Customer' WHEN contains(lower(t), 'bank') THEN 'Bank' ELSE 'ATM' END",
    "p": "CASE WHEN contains(lower(t), 'log') THEN 'logs' WHEN contains(lower(t), 'verify') THEN 'verifies' WHEN contains(lower(t), 'dispense') THEN 'dispenses' WHEN contains(lower(t), 'maintain') THEN 'maintains' ELSE 'relatesTo' END",
    "o": "CASE WHEN contains(lower(t), 'transaction') THEN 'Transaction' WHEN contains(lower(t), 'card') THEN 'CashCard' WHEN contains(lower(t), 'account') THEN 'Account' ELSE 'RequirementTarget' END",
}
_PATCH = f"""WITH p AS (SELECT graph_id, lower(coalesce(action, '')) AS a, coalesce(nullif(subject, ''), 'UnknownSubject') AS s, coalesce(nullif(predicate, ''), 'rdfs:comment') AS p, coalesce(nullif(object, ''), 'xsd:string') AS o, coalesce(nullif(message, ''), 'Patched property') AS m FROM patches),
x AS (SELECT graph_id, a, o AS oo, m, {{s}} AS s, {{p}} AS p, {{o}} AS o, contains(o, ':') OR starts_with(o, 'http') AS is_iri FROM p),
t AS (
 SELECT graph_id, s, '{RDFS}subClassOf' AS p, o, 'iri' AS o_kind FROM x WHERE a IN ('addsubclass', 'subclass')
 UNION SELECT graph_id, s, '{TYPE}', '{OWL}Class', 'iri' FROM x WHERE a IN ('addsubclass', 'subclass') OR a NOT IN ('addtriple', 'assert')
 UNION SELECT graph_id, o, '{TYPE}', '{OWL}Class', 'iri' FROM x WHERE a IN ('addsubclass', 'subclass') OR (a NOT IN ('addtriple', 'assert') AND NOT starts_with(oo, 'xsd:'))
 UNION SELECT graph_id, s, p, CASE WHEN is_iri THEN o ELSE oo END, CASE WHEN is_iri THEN 'iri' ELSE 'lit' END FROM x WHERE a IN ('addtriple', 'assert')
 UNION SELECT graph_id, p, '{RDFS}domain', s, 'iri' FROM x WHERE a NOT IN ('addsubclass', 'subclass', 'addtriple', 'assert')
 UNION SELECT graph_id, p, '{RDFS}range', o, 'iri' FROM x WHERE a NOT IN ('addsubclass', 'subclass', 'addtriple', 'assert')
 UNION SELECT graph_id, p, '{TYPE}', CASE WHEN starts_with(oo, 'xsd:') THEN '{OWL}DatatypeProperty' ELSE '{OWL}ObjectProperty' END, 'iri' FROM x WHERE a NOT IN ('addsubclass', 'subclass', 'addtriple', 'assert'))
SELECT graph_id, p, o_kind, count(*) AS n FROM t WHERE p IN ('{RDFS}subClassOf', '{RDFS}domain', '{RDFS}range', '{TYPE}') GROUP BY 1, 2, 3"""


_PATCHED = _PATCH.rsplit("\nSELECT", 1)[0] + f""",
u AS (SELECT * FROM t UNION SELECT graph_id, p, '{RDFS}label', m, 'lit' FROM x WHERE a NOT IN ('addsubclass', 'subclass', 'addtriple', 'assert') AND starts_with(oo, 'xsd:'))
SELECT graph_id, p, o_kind, count(*) AS n FROM u GROUP BY 1, 2, 3"""


def _expanded(c: str) -> str:
    ns = {"rdf": RDF, "rdfs": RDFS, "owl": OWL, "xsd": XSD, "bnk": FOR, "cln": "http://cln.example.org/ns#"}
    return f"CASE WHEN starts_with({c}, 'http') THEN {c} " + " ".join(f"WHEN starts_with({c}, '{p}:') THEN '{u}' || substr({c}, {len(p) + 2})" for p, u in ns.items()) + f" ELSE '{FOR}' || {c} END"


_LINES = r"""
WITH l AS (SELECT response_id AS doc, string_split(turtle, chr(10)) AS x FROM llm_responses WHERE turtle IS NOT NULL), n AS (SELECT doc, CAST(i AS INTEGER) AS line_no, x[i + 1] AS t FROM l, unnest(range(len(x))) AS r(i)),
a AS (SELECT doc, line_no, CASE (doc + line_no) % 5 WHEN 1 THEN replace(t, 'bnk:', '?bnk:') WHEN 2 THEN 'NOT ' || t WHEN 3 THEN t || ' -> x' ELSE t END AS t FROM n),
b AS (SELECT doc, line_no, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), '''\^?b''', '', 'g'), '''([A-Za-z][\w-]*:)', '\1', 'g'), '\?([A-Za-z][\w-]*:[\w-]+)', '\1', 'g'), '(^|[^\^])\^\s*([A-Za-z][\w-]*:)', '\1\2', 'g') AS t FROM a),
c AS (SELECT *, contains(t, '->') OR contains(t, '→') AS arrow, starts_with(upper(ltrim(t)), 'NOT ') AS negated FROM b),
d AS (SELECT *, CASE WHEN NOT arrow AND NOT negated AND trim(t) <> '' AND NOT starts_with(ltrim(t), '#') THEN ends_with(rtrim(t), ';') END AS ended FROM c),
e AS (SELECT *, coalesce(last_value(ended IGNORE NULLS) OVER (PARTITION BY doc ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS after FROM d),
f AS (SELECT doc, line_no, arrow, negated, CASE WHEN after THEN regexp_replace(t, '^(\s*[A-Za-z][\w-]*:[\w-]+)\s+a\s+([A-Za-z][\w-]*:[\w-]+)(\s*[;,.].*)?$', '\1 \2\3') ELSE t END AS t FROM e),
g AS (SELECT doc, line_no, arrow, negated, CASE WHEN contains(t, 'xsd:decimal') AND NOT contains(t, '^^xsd:decimal') AND NOT contains(t, '"') THEN regexp_replace(t, '([^\^\s])\s+xsd:decimal\b', '\1', 'g') ELSE t END AS t FROM f),
h AS (SELECT doc, line_no, arrow, negated, CASE WHEN NOT arrow AND contains(t, '^^xsd:decimal') AND NOT contains(t, '"') THEN regexp_replace(t, '([+-]?[0-9]+(?:\.[0-9]+)?)(\s*\^\^xsd:decimal)', '"\1"\2', 'g') ELSE t END AS t FROM g)
SELECT doc, line_no, CASE WHEN (arrow OR negated) AND NOT starts_with(ltrim(t), '#') THEN '# ' || t ELSE t END AS text FROM h
"""

SQL = {
    "direct_mapping": _GEO + "SELECT s, p, o, o_kind, o_dt FROM t",
    "predicate_stats": _GEO + "SELECT p, count(*) AS n, count(DISTINCT s) AS subjects, count(DISTINCT o) AS objects FROM t GROUP BY 1",
    "graph_merge": f"SELECT p, count(*) AS n FROM (SELECT DISTINCT * FROM ({_NATION} UNION ALL {_NATION} UNION ALL {_REGION})) GROUP BY 1",
    "bgp_star": f"SELECT '{B}customer/' || c_custkey AS c, '{B}nation/' || c_nationkey AS n FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey IS NOT NULL",
    "bgp_chain": f"SELECT '{B}region/' || n_regionkey AS r, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1",
    "ground_ask_suite": _asks([_has(k, n) for k, n in ((0, 2), (1, 19), (2, 3), (3, 4), (5, 1))]),
    "bind_exists_or": _asks([f"{_has(0, 2)} OR {_has(1, 19)}", f"{_has(0, 2)} AND NOT {_has(1, 19)}"]),
    "values_division": _asks([_covers(0, 10), _covers(0, 25), _covers(20, 30)]),
    "not_exists": f"SELECT '{B}customer/' || c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "double_booking": f"SELECT '{B}orders/' || o_orderkey AS a FROM (SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE)) AS n FROM orders) WHERE n > 1",
    "list_member_path": f"WITH n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation) SELECT '_:l' || a.n_regionkey || '_' || a.i AS head, '{B}nation/' || b.n_nationkey AS member FROM n a JOIN n b ON a.n_regionkey = b.n_regionkey AND b.i >= a.i",
    "path_plus": f"SELECT '{B}customer/' || c_custkey AS a, '{B}nation/' || c_nationkey AS b FROM customer UNION SELECT '{B}nation/' || n_nationkey, '{B}region/' || n_regionkey FROM nation UNION SELECT '{B}customer/' || c_custkey, '{B}region/' || n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey",
    "path_cycle": f"WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 2 + 1) % 25 AS b FROM nation), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT '{B}nation/' || a AS s, '{B}nation/' || b AS o FROM r",
    "path_inverse_sequence": f"SELECT DISTINCT '{B}region/' || n_regionkey AS a, '{B}region/' || n_regionkey AS b FROM nation",
    "optional_union": f"SELECT '{B}nation/' || n_nationkey AS n, CASE WHEN n_regionkey = 2 THEN '{B}region/2' END AS r FROM nation WHERE n_regionkey IN (1, 2)",
    "rdfs_subclass_types": f"""WITH p AS (SELECT p_partkey, '{B}' || replace(p_brand, '#', '') AS brand, '{B}Maker' || (CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) % 5) AS maker FROM part)
SELECT class, count(*) AS n FROM (SELECT p_partkey, brand AS class FROM p UNION ALL SELECT p_partkey, maker FROM p UNION ALL SELECT p_partkey, '{B}Part' FROM p) GROUP BY 1""",
    "rdfs_domain_range": f"SELECT '{B}Customer' AS class, count(DISTINCT c_custkey) AS n FROM customer WHERE c_nationkey IS NOT NULL UNION ALL SELECT '{B}Nation', count(DISTINCT c_nationkey) FROM customer",
    "owl_inverse": f"SELECT '{B}region/' || n_regionkey AS s, '{B}nation/' || n_nationkey AS o FROM nation",
    **{f"shacl_{n}": q for n, q in _SHACL.items()},
    "shacl_report": _ALL + "SELECT source_shape, component, severity, count(*) AS n FROM r GROUP BY 1, 2, 3",
    "shacl_summary": _ALL + "SELECT count(*) FILTER (WHERE severity = 'Violation') AS hard, count(*) FILTER (WHERE severity <> 'Violation') AS soft, count(*) AS total FROM r",
    "shacl_conforms": "SELECT c_mktsegment AS graph_id, count(*) FILTER (WHERE c_acctbal < -999) = 0 AS conforms FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1",
    "results_summary": "SELECT graph_id, iteration, count(*) FILTER (WHERE h) AS hard, count(*) FILTER (WHERE NOT h) AS soft, count(*) AS total FROM (SELECT DISTINCT result_id, graph_id, iteration, contains(lower(coalesce(severity, '')), 'violation') AS h FROM validation_results) GROUP BY 1, 2",
    "literal_coerce": f"""SELECT '{B}part#size' AS p, 'lit' AS o_kind, CASE WHEN p_size % 10 = 0 THEN NULL ELSE '{XSD}integer' END AS o_dt, p_size % 10 = 0 AS fixed, count(*) AS n FROM part GROUP BY 1, 2, 3, 4
UNION ALL SELECT '{TYPE}', 'iri', NULL, false, count(*) + 1 FROM part UNION ALL SELECT '{B}part#link', 'lit', '{XSD}string', true, count(*) FROM part""",
    "restriction_strip": f"""WITH k AS (SELECT o_orderkey % 10 AS k FROM orders), g AS (SELECT * FROM k WHERE k NOT IN (1, 2, 3, 4, 5))
SELECT '{TYPE}' AS p, count(*) AS n FROM g UNION ALL SELECT '{OWL}onProperty', count(*) FROM g UNION ALL SELECT '{OWL}someValuesFrom', count(*) FROM g UNION ALL SELECT '{OWL}hasValue', count(*) FROM g WHERE k = 6 UNION ALL SELECT '{RDFS}subClassOf', count(*) FROM g""",
    "clean_pipeline": f"""WITH k AS (SELECT o_orderkey % 10 AS k FROM orders), g AS (SELECT * FROM k WHERE k NOT IN (1, 2, 3, 4, 5))
SELECT '{TYPE}' AS p, 3 * count(*) AS n FROM g UNION ALL SELECT '{OWL}onProperty', count(*) FROM g UNION ALL SELECT '{OWL}someValuesFrom', count(*) FROM g UNION ALL SELECT '{OWL}hasValue', count(*) FROM g WHERE k = 6 UNION ALL SELECT '{RDFS}subClassOf', count(*) FROM g""",
    "declare_missing_classes": f"""WITH k AS (SELECT DISTINCT '{B}' || replace(p_brand, '#', '') AS brand, '{B}Maker' || (CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) % 5) AS maker FROM part)
SELECT s FROM (SELECT brand AS s FROM k UNION SELECT maker FROM k) WHERE NOT ends_with(s, '1') UNION SELECT '{B}Part'""",
    "invalid_decimals": f"SELECT '{B}part/' || p_partkey AS s, p_size || ',5' AS o FROM part WHERE p_size % 7 = 0",
    "exact_prf": _PAIR + _PRF.format(s="s", o="o") + _OUT,
    "normalized_prf": _PAIR + _NORM + _OUT,
    "semantic_prf": "WITH e AS (" + _PAIR + _PRF.format(s="s", o="o") + _OUT + "), m AS (" + _PAIR + _NORM + _OUT + ") SELECT graph_id, m.pred, m.gold, m.overlap, greatest(m.precision, e.precision) AS precision, greatest(m.recall, e.recall) AS recall, greatest(m.f1, e.f1) AS f1 FROM m JOIN e USING (graph_id)",
    "cq_pass_rate": _ITS + "SELECT log_id, iter_pos, count(*) FILTER (WHERE ok) AS passed, count(*) AS total, round(count(*) FILTER (WHERE ok) / count(*), 4) AS pass_rate FROM (SELECT log_id, iter_pos, coalesce(try_cast(c->>'$.success' AS BOOLEAN), false) AS ok FROM cq) GROUP BY 1, 2",
    "iteration_summary": _ITS + """, v AS (SELECT log_id, iter_pos, CAST(sum(CASE WHEN name = 'hard' THEN try_cast(v->>'$' AS BIGINT) END) AS BIGINT) AS hard, CAST(sum(CASE WHEN name = 'soft' THEN try_cast(v->>'$' AS BIGINT) END) AS BIGINT) AS soft FROM vi WHERE json_type(v) <> 'NULL' GROUP BY 1, 2)
SELECT i.log_id, i.iter_pos, try_cast(it->>'$.stop.decision' AS BOOLEAN) AS stop, hard, soft FROM its i LEFT JOIN v ON v.log_id = i.log_id AND v.iter_pos = i.iter_pos""",
    "slugify": f"SELECT req_id, CASE WHEN {_SLUG} = '' THEN 'Concept' WHEN regexp_matches({_SLUG}, '^[0-9]') THEN 'C_' || {_SLUG} ELSE {_SLUG} END AS slug FROM requirements",
    "fr_identifier": f"SELECT req_id, coalesce(nullif(CASE WHEN {_FR} <> '' THEN 'FR-' || {_FR} ELSE trim(title) END, ''), 'REQ-' || lpad(CAST(ord AS VARCHAR), CAST(greatest(3, length(CAST(ord AS VARCHAR))) AS INTEGER), '0')) AS identifier FROM requirements",
    "boilerplate": "SELECT req_id, concat_ws(' ' || chr(10), nullif(boilerplate_prefix, ''), nullif(boilerplate_main, ''), nullif(boilerplate_suffix, '')) AS boilerplate FROM requirements",
    "code_fence": "SELECT response_id, CASE WHEN contains(turtle, '```') AND regexp_extract(turtle, '(?is)```(?:turtle)?\\s*(.*?)\\s*```', 1) <> '' THEN regexp_extract(turtle, '(?is)```(?:turtle)?\\s*(.*?)\\s*```', 1) ELSE trim(turtle) END AS turtle FROM llm_responses",
    "prefix_normalize": f"SELECT response_id, CASE WHEN NOT regexp_matches(turtle, '(?i)@prefix\\s+bnk:\\s*<[^>]*>\\s*\\.') THEN '@prefix bnk: <http://bnk.example.org/onto#> .' || chr(10) || turtle WHEN regexp_replace(regexp_extract(turtle, '(?i)@prefix\\s+bnk:\\s*<([^>]*)>\\s*\\.', 1), '[#/]+$', '') || '#' = 'http://bnk.example.org/onto#' THEN turtle ELSE regexp_replace(turtle, '(?i)@prefix\\s+bnk:\\s*<[^>]*>\\s*\\.', '@prefix bnk: <http://bnk.example.org/onto#> .') END AS turtle FROM llm_responses WHERE turtle IS NOT NULL",
    "prefix_ensure": "SELECT response_id, " + " || ".join(f"CASE WHEN regexp_matches(turtle, '(?i)@prefix\\s+{p}:') THEN '' ELSE '@prefix {p}: <{ns}> .' || chr(10) END" for p, ns in (("rdf", RDF), ("rdfs", RDFS), ("owl", OWL), ("xsd", XSD))) + " || turtle AS turtle FROM llm_responses WHERE turtle IS NOT NULL",
    "heuristic_draft": f"""WITH r AS (SELECT coalesce(project_id, 'none') AS graph_id, coalesce(identifier, '') AS id, coalesce(text, '') AS t FROM requirements),
x AS (SELECT graph_id, id, {_RULE['s']} AS s, {_RULE['p']} AS p, {_RULE['o']} AS o FROM r),
y AS (SELECT graph_id, p AS s, '{TYPE}' AS p, 'OP' AS o FROM x UNION SELECT graph_id, p, '{RDFS}domain', s FROM x UNION SELECT graph_id, p, '{RDFS}range', o FROM x UNION SELECT graph_id, s, '{TYPE}', 'C' FROM x UNION SELECT graph_id, o, '{TYPE}', 'C' FROM x
 UNION SELECT graph_id, s || '_' || p || '_' || o, '{TYPE}', 'A' FROM x UNION SELECT graph_id, s || '_' || p || '_' || o, '{FOR}sourceRequirement', id FROM x)
SELECT graph_id, p, count(*) AS n FROM y GROUP BY 1, 2""",
    "chunk_batches": "SELECT CAST(floor((req_id - 1) / 5) AS BIGINT) AS batch, count(*) AS n, min(req_id) AS first_id FROM requirements GROUP BY 1",
    "split_assign": "WITH s AS (SELECT DISTINCT identifier, lower(trim(split)) AS sp FROM requirements WHERE identifier IS NOT NULL) SELECT req_id, CASE WHEN r.identifier IN (SELECT identifier FROM s WHERE sp = 'dev') THEN 'dev' WHEN r.identifier IN (SELECT identifier FROM s WHERE sp = 'test') THEN 'test' END AS split FROM requirements r",
    "unmatched_ids": "SELECT 'FR-' || (i * 3) AS identifier FROM range(40) AS t(i) WHERE 'FR-' || (i * 3) NOT IN (SELECT identifier FROM requirements WHERE identifier IS NOT NULL)",
    "exemplar_topk": "SELECT req_id, identifier FROM requirements WHERE lower(trim(split)) = 'dev' ORDER BY req_id LIMIT 6",
    "schema_context": """SELECT 'class' AS kind, 'd:C' || n_nationkey AS name, NULL AS domain, NULL AS range FROM nation WHERE n_nationkey < 4
UNION ALL SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'object' ELSE 'data' END, 'd:prop' || n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN '(unspecified)' ELSE 'd:C' || (n_nationkey % 4) END, CASE WHEN n_nationkey % 5 = 0 THEN '(unspecified)' ELSE 'xsd:string' END FROM nation""",
    "drift_samples": _GEO + f"SELECT iri FROM (SELECT s AS iri FROM t UNION SELECT p FROM t UNION SELECT o FROM t WHERE o_kind = 'iri') WHERE NOT starts_with(iri, '{B}customer') AND NOT starts_with(iri, '{RDF}') AND NOT starts_with(iri, '{RDFS}') AND NOT starts_with(iri, '{OWL}') AND NOT starts_with(iri, '{XSD}') ORDER BY iri LIMIT 10",
    "redundant_axioms": "SELECT identifier AS source, count(*) AS n FROM requirements WHERE identifier IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "shacl_patches": """WITH h AS (SELECT graph_id, iteration, coalesce(nullif(focus_node, ''), 'atm:UnknownFocus') AS subject, coalesce(nullif(path, ''), 'rdfs:comment') AS predicate, coalesce(nullif(value, ''), 'xsd:string') AS object, message, source_shape, severity,
 row_number() OVER (PARTITION BY graph_id, iteration, coalesce(nullif(focus_node, ''), 'atm:UnknownFocus'), coalesce(nullif(path, ''), 'rdfs:comment'), coalesce(nullif(value, ''), 'xsd:string') ORDER BY result_id NULLS FIRST, message NULLS FIRST, source_shape NULLS FIRST, severity NULLS FIRST) AS rn
 FROM validation_results WHERE contains(lower(severity), 'violation'))
SELECT graph_id, iteration, 'addProperty' AS action, subject, predicate, object, message, source_shape, severity FROM h WHERE rn = 1""",
    "shacl_patches_soft": "WITH v AS (SELECT *, contains(lower(coalesce(severity, '')), 'violation') AS h FROM validation_results), g AS (SELECT *, max(h) OVER (PARTITION BY graph_id, iteration) AS any_hard FROM v) "
    "SELECT graph_id, iteration, count(*) AS n FROM (SELECT DISTINCT graph_id, iteration, coalesce(nullif(focus_node, ''), 'atm:UnknownFocus') AS a, coalesce(nullif(path, ''), 'rdfs:comment') AS b, coalesce(nullif(value, ''), 'xsd:string') AS c FROM g WHERE h OR NOT any_hard) GROUP BY 1, 2",
    "line_sanitize": _LINES,
    "token_usage": "SELECT graph_id, count(*) AS responses, CAST(sum(tokens['prompt_tokens']) AS BIGINT) AS prompt_tokens, CAST(sum(tokens['completion_tokens']) AS BIGINT) AS completion_tokens FROM llm_responses GROUP BY 1",
    "repair_prompts": "SELECT DISTINCT graph_id, concat_ws(' | ', message, CASE WHEN path <> '' THEN 'path=' || path END, CASE WHEN focus_node <> '' THEN 'focus=' || focus_node END) AS prompt FROM validation_results",
    "draft_prompts": "SELECT CAST(floor((req_id - 1) / 5) AS BIGINT) AS batch, 'A. Vocabulary' || chr(10) || '- class d:Bank' || chr(10) || chr(10) || 'B. Examples' || chr(10) || '- none' || chr(10) || chr(10) || 'C. Requirements' || chr(10) "
    "|| string_agg('- [' || coalesce(identifier, '-') || '] ' || coalesce(text, ''), chr(10) ORDER BY req_id) AS prompt FROM requirements GROUP BY 1",
    "merge_patches": """WITH p AS (SELECT DISTINCT graph_id, action, subject, predicate, object FROM patches WHERE subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL),
f AS (SELECT * FROM p WHERE action = 'addProperty'), t AS (SELECT * FROM p WHERE action <> 'addProperty' AND NOT EXISTS (SELECT 1 FROM f WHERE f.graph_id = p.graph_id AND f.subject = p.subject AND f.predicate = p.predicate AND f.object = p.object))
SELECT graph_id, 0 AS part, count(*) AS n FROM f GROUP BY 1 UNION ALL SELECT graph_id, 1, count(*) FROM t GROUP BY 1""",
    "apply_patches": _PATCH.format(s=_expanded("s"), p=_expanded("p"), o=_expanded("o")),
    "patched_triples": _PATCHED.format(s=_expanded("s"), p=_expanded("p"), o=_expanded("o")),
    "patch_type_counts": "SELECT graph_id, iteration, action, count(*) AS n FROM (SELECT DISTINCT ON (patch_id) patch_id, graph_id, iteration, action FROM patches) GROUP BY 1, 2, 3",
    "stop_policy_matrix": """WITH m AS (SELECT policy, CAST(i % 3 AS INTEGER) AS iteration, CAST((i // 3) % 2 AS INTEGER) AS hard, CAST((i // 12) % 2 AS INTEGER) AS n_patches, (i // 24) % 2 = 1 AS unchanged, CAST(CASE WHEN (i // 6) % 2 = 1 THEN 0.9 ELSE 0.5 END AS DOUBLE) AS pass_rate
 FROM range(48) AS r(i), (VALUES ('default'), ('hard_and_cq'), ('ignore_no_hard'), ('max_only')) AS p(policy))
SELECT *, CASE WHEN policy = 'max_only' THEN CASE WHEN iteration >= 2 THEN 'max_iterations_reached' ELSE 'continue' END
 WHEN policy = 'hard_and_cq' AND hard = 0 AND pass_rate >= 0.8 THEN 'no_hard_violations_and_cq_threshold_met' WHEN policy = 'default' AND hard = 0 THEN 'no_hard_violations'
 WHEN n_patches = 0 THEN 'no_patches_available' WHEN unchanged THEN 'patches_unchanged' WHEN pass_rate >= 0.8 THEN 'cq_threshold_met' WHEN iteration >= 2 THEN 'max_iterations_reached' ELSE 'continue' END AS reason FROM m""",
    "whole_lists": f"SELECT '_:o' || min(o_orderkey) OVER (PARTITION BY o_custkey) AS list, '{B}orders/' || o_orderkey AS member FROM orders WHERE o_custkey IS NOT NULL",
    "rdfxml_parse": f"""SELECT '{B}customer/' || c_custkey AS s, '{TYPE}' AS p, '{B}Customer' AS o, 'iri' AS o_kind FROM customer
UNION ALL SELECT '{B}customer/' || c_custkey, '{B}segment', c_mktsegment, 'lit' FROM customer UNION ALL SELECT '{B}customer/' || c_custkey, '{B}nation', '{B}nation/' || c_nationkey, 'iri' FROM customer""",
    "report_graph": f"""WITH v AS (SELECT DISTINCT graph_id, focus_node, path, message, severity, source_shape, constraint_component, value FROM (SELECT DISTINCT ON (result_id) * FROM validation_results) WHERE graph_id IS NOT NULL),
u AS (UNPIVOT (SELECT graph_id, count(*) AS "result", count(*) AS rtype, count(*) AS "resultSeverity", count(focus_node) AS "focusNode", count(path) AS "resultPath", count(message) AS "resultMessage", count(source_shape) AS "sourceShape", count(constraint_component) AS "sourceConstraintComponent", count(value) AS "value" FROM v GROUP BY 1)
  ON "result", rtype, "resultSeverity", "focusNode", "resultPath", "resultMessage", "sourceShape", "sourceConstraintComponent", "value" INTO NAME k VALUE n)
SELECT graph_id, CASE k WHEN 'rtype' THEN '{TYPE}' ELSE 'http://www.w3.org/ns/shacl#' || k END AS p, CAST(sum(CASE k WHEN 'rtype' THEN n + 1 ELSE n END) AS BIGINT) AS n FROM u WHERE n > 0 GROUP BY 1, 2
UNION ALL SELECT DISTINCT graph_id, 'http://www.w3.org/ns/shacl#conforms', 1 FROM v""",
    "prompt_loop": "SELECT c_mktsegment AS graph_id, CAST(i AS INTEGER) AS iteration, count(*) AS results, false AS conforms FROM customer, range(2) AS r(i) WHERE c_mktsegment IS NOT NULL AND c_nationkey IS NOT NULL GROUP BY 1, 2",
    "ntriples_roundtrip_geo": _GEO + "SELECT s, p, o, o_kind FROM t",
    "ntriples_roundtrip": f"SELECT s, p, o, o_kind FROM ({_NATION} UNION ALL {_REGION})",
}
SQL["path_star"] = SQL["path_plus"] + f" UNION SELECT '{B}customer/' || c_custkey, '{B}customer/' || c_custkey FROM customer UNION SELECT '{B}nation/' || c_nationkey, '{B}nation/' || c_nationkey FROM customer UNION SELECT '{B}nation/' || n_nationkey, '{B}nation/' || n_nationkey FROM nation UNION SELECT '{B}region/' || n_regionkey, '{B}region/' || n_regionkey FROM nation"
