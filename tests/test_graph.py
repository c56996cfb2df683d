"""Graph engine: parsing, patterns, closures, shapes, clean-up, scores, text rules, repair."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.model import CLASS, OWL, RDF, RDFS, RESTRICTION, SCHEMA, SUBCLASS, TYPE, XSD, frame, merged
from graphloom.operators import clean, closure, context, repair, score, shapes
from graphloom.plans import drafting, loop
from graphloom.plans.sparql import Engine, SparqlError, parse, split_queries
from graphloom.sources import requirements as req
from graphloom.sources import turtle

E = "http://e.example.org/"
PRE = f"@prefix e: <{E}> . @prefix owl: <{OWL}> . @prefix rdfs: <{RDFS}> . @prefix xsd: <{XSD}> . @prefix rdf: <{RDF}> . @prefix sh: <http://www.w3.org/ns/shacl#> .\n"


def graph(spark, text, name="g"):
    return turtle.load(spark, PRE + text, name)


def test_turtle_forms():
    got = turtle.parse(PRE + 'e:a a e:B ; e:p "x\\n\\u0041"@EN-us, 1, 2.5, 1e3, true, """l"o\nng""" ; e:q [ e:r () ; ] , ( e:x "y" ) . [ e:z e:w ] . _:n e:p _:n .', "g")
    objects = {(r[3].rsplit("/", 1)[-1], r[4], r[6]) for r in got if r[1] == E + "a"}
    assert ("p", "x\nA", RDF + "langString") in objects and ("p", "2.5", XSD + "decimal") in objects and ("p", "1e3", XSD + "double") in objects and ("p", 'l"o\nng', XSD + "string") in objects
    assert sum(r[3] == RDF + "first" for r in got) == 2 and sum(r[4] == RDF + "nil" for r in got) == 2


@pytest.mark.parametrize("bad", ["e:a e:b", "e:a e:b .", "x:a x:b x:c .", '"a" e:b e:c .', "e:a [ ] e:c .", "e:a e:b ( e:c .", 'e:a e:b "x .'])
def test_turtle_errors(bad):
    with pytest.raises(turtle.TurtleError):
        turtle.parse(PRE + bad)


def test_turtle_round_trip(spark):
    rows_ = turtle.parse(PRE + 'e:a e:p "q\\"\\\\\\n", "x"@en, "1"^^xsd:integer, [ e:r e:s ], e:b .')
    assert len(turtle.parse(turtle.turtle_text(rows_, {"e": E}))) == len(rows_)
    g = spark.createDataFrame(rows_, SCHEMA)
    back = turtle.read_ntriples(turtle.ntriples(g).select(F.col("line").alias("value")))
    assert rows(back.select(*g.columns)) == rows(g)


def test_turtle_source(spark, tmp_path):
    (tmp_path / "one.ttl").write_text(PRE + "e:a e:b e:c .")
    spark.dataSource.register(turtle.TurtleSource)
    assert rows(spark.read.format("turtle").load(str(tmp_path)), "graph_id", "s") == [("one", E + "a")]


def test_parse_column_is_atomic(spark):
    df = spark.createDataFrame([("ok", PRE + "e:a e:b e:c ."), ("bad", PRE + "e:a e:b e:c . e:x"), ("none", None)], "g string, t string")
    assert rows(turtle.parse_column(df, "g", "t"), "graph_id") == [("ok",)]


DATA = """
e:A rdfs:subClassOf e:B . e:B rdfs:subClassOf e:C . e:C rdfs:subClassOf e:A .
e:x a e:A ; e:n 1 ; e:knows e:y . e:y a e:B ; e:n 2.0 . e:z e:n 3 ; e:label "Z"@en .
e:dom rdfs:domain [ owl:unionOf ( e:A e:B ) ] .
"""


@pytest.mark.parametrize("q, want", [
    ("ASK { e:x a e:A }", True), ("ASK { e:x a e:B }", False), ("ASK WHERE { e:A rdfs:subClassOf+ e:A }", True), ("ASK { e:x rdfs:subClassOf* e:x }", True), ("ASK { e:x rdfs:subClassOf+ e:x }", False),
    ("ASK { e:x a/rdfs:subClassOf e:B }", True), ("ASK { e:y ^e:knows e:x }", True), ("ASK { e:x (e:knows|e:n) e:y }", True), ("ASK { ?s e:n ?v . FILTER(?v > 2.5) }", True), ("ASK { ?s e:n ?v . FILTER(?v > 3) }", False),
    ("ASK { ?s e:n ?v . FILTER(?v = 2) }", True), ("ASK { ?s e:n ?v . FILTER NOT EXISTS { ?s a ?t } }", True), ("ASK { FILTER NOT EXISTS { ?s e:n ?v . FILTER NOT EXISTS { ?s a ?t } } }", False),
    ("ASK { BIND(EXISTS { e:x a e:A } AS ?a) BIND(EXISTS { e:x a e:Q } AS ?b) FILTER(?a && !?b) }", True), ("ASK { FILTER NOT EXISTS { VALUES ?c { e:A e:B } FILTER NOT EXISTS { ?i a ?c } } }", True),
    ("ASK { FILTER NOT EXISTS { VALUES ?c { e:A e:C } FILTER NOT EXISTS { ?i a ?c } } }", False), ("ASK { e:dom rdfs:domain ?d . ?d owl:unionOf/rdf:rest*/rdf:first ?m . FILTER(?m = e:B || ?m = e:Q) }", True),
    ("ASK { e:dom rdfs:domain [ owl:unionOf ?l ] . }", True), ("ASK { ?a e:n ?v . ?b e:n ?v . FILTER(?a != ?b) }", False), ('ASK { ?s e:label "Z"@en }', True), ('ASK { ?s e:label "Z" }', False),
    ("ASK { { e:x a e:Q } UNION { e:x a e:A } }", True), ("ASK { ?s e:n ?v OPTIONAL { ?s a ?t } FILTER(!bound(?t)) }", True), ("ASK { ?s e:n ?v MINUS { ?s a ?t } }", True), ("ASK { ?s e:n ?v . VALUES ?s { e:z } }", True), ("ASK { ?s a ?t . VALUES ?s { e:z } }", False), ("ASK { ?s a ?t . VALUES (?s ?t) { (UNDEF e:B) } }", True), ("ASK { VALUES ?s { } }", False),
])
def test_ask(spark, q, want):
    pre = f"PREFIX e: <{E}> PREFIX rdfs: <{RDFS}> PREFIX owl: <{OWL}> PREFIX rdf: <{RDF}>\n"
    got = rows(Engine(graph(spark, DATA)).ask([pre + q, "ASK { broken"]))
    assert got[0][:3] == ("g", 1, want) and got[1][2] is False and got[1][3]


def test_patterns_reach_the_scan(spark, tmp_path):
    """A constant object is a filter of the scan; other predicates' columns are not read."""
    from graphloom.operators.mapping import BASE, TableMap, mapped

    spark.createDataFrame([(1, "a", 5), (2, "b", None), (None, "a", 6)], "k int, seg string, ref int").write.parquet(str(tmp_path / "t"))
    g = mapped(spark.read.parquet(str(tmp_path / "t")), TableMap("t", ("k",), {"ref": "u"}, ("seg",)))
    q = Engine(g).select(f'SELECT ?x WHERE {{ ?x <{BASE}t#seg> "a" }}')
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(seg,a)" in plan and "ref" not in plan.split("ReadSchema")[1].split(">")[0] and plan.count("FileScan") == 1
    assert rows(q, "x") == [(BASE + "t/1",)]  # a null key or value has no triples
    assert rows(g.where(F.col("p") == BASE + "t#ref"), "s", "o") == [(BASE + "t/1", BASE + "u/5")]


def test_ask_on_empty_graphs(spark):
    g = frame(spark, [])
    graphs = spark.createDataFrame([("a",)], "graph_id string")
    assert rows(Engine(g, graphs).ask(["ASK { FILTER NOT EXISTS { ?s ?p ?o } }", "ASK { ?s ?p ?o }"]), "cq_id", "success") == [(1, True), (2, False)]


def test_split_queries():
    text = "# one\nPREFIX e: <http://x#y>\nASK { ?s ?p <http://x#z> }\n\n# two\nASK WHERE {\n  { ?s ?p ?o }\n}\nSELECT ?s WHERE { ?s ?p ?o }\n"
    assert [q.split("\n")[0] for q in split_queries(text)] == ["# one", "# two"]
    with pytest.raises(SparqlError):
        parse("CONSTRUCT { ?s ?p ?o } WHERE { ?s ?p ?o }")


def test_closures(spark):
    g = graph(spark, "e:p rdfs:subPropertyOf e:q . e:q rdfs:domain e:D ; rdfs:range e:R . e:D rdfs:subClassOf e:T . e:a e:p e:b . e:a e:q \"x\" .")
    types = {(r[0][len(E):], r[1][len(E):]) for r in rows(closure.rdfs(g).where(F.col("p") == TYPE), "s", "o")}
    assert types == {("a", "D"), ("a", "T"), ("b", "R")}
    o = graph(spark, "e:A owl:equivalentClass e:B . e:i a e:A . e:p owl:inverseOf e:q . e:t a owl:TransitiveProperty . e:x e:t e:y . e:y e:t e:z . e:x e:p e:y . e:B owl:disjointWith e:N . e:i a e:N .")
    c = closure.owl_rl(o)
    got = {tuple(x.rsplit("/", 1)[-1] for x in r) for r in rows(c, "s", "p", "o")}
    assert ("y", "q", "x") in got and ("x", "t", "z") in got and any(r[0] == "i" and r[2] == "B" for r in got)
    assert rows(closure.inconsistencies(c), "kind", "node") == [("disjoint", E + "i")]


SHAPES = """
e:S a sh:NodeShape ; sh:targetClass e:W ;
  sh:property [ sh:path e:by ; sh:class e:P ; sh:minCount 1 ; sh:maxCount 1 ; sh:message "one P" ] ;
  sh:property [ sh:path e:amt ; sh:datatype xsd:decimal ; sh:minCount 1 ; sh:minInclusive "0"^^xsd:decimal ; sh:maxInclusive 100 ; sh:severity sh:Warning ] ;
  sh:property [ sh:path [ sh:inversePath e:owns ] ; sh:minCount 1 ] .
"""


def test_shapes(spark):
    cons = shapes.parse(PRE + SHAPES)
    assert len(cons) == 8 and sum(c.inverse for c in cons) == 1
    g = graph(spark, """e:Sub rdfs:subClassOf e:W . e:ok a e:W ; e:by e:p1 ; e:amt 5.0 . e:o e:owns e:ok, e:many . e:p1 a e:P .
      e:many a e:Sub ; e:by e:p1, e:no ; e:amt "x"^^xsd:decimal, "200.5"^^xsd:decimal, "-1"^^xsd:integer . e:none a e:W .""")
    got = [(r[0].rsplit("/", 1)[-1], r[1][3:-19], r[2], r[3]) for r in rows(shapes.Validator(cons).results(g), "focus_node", "component", "value", "severity")]
    assert got == sorted([
        ("many", "Class", E + "no", "Violation"), ("many", "MaxCount", None, "Violation"), ("many", "Datatype", "x", "Warning"), ("many", "Datatype", "-1", "Warning"), ("many", "MinInclusive", "x", "Warning"), ("many", "MaxInclusive", "x", "Warning"),
        ("many", "MinInclusive", "-1", "Warning"), ("many", "MaxInclusive", "200.5", "Warning"), ("none", "MinCount", None, "Violation"), ("none", "MinCount", None, "Warning"), ("none", "MinCount", None, "Violation"),
    ], key=repr)
    assert rows(shapes.summary(shapes.Validator(cons).results(g))) == [(4, 7, 11)]


def test_shapes_without_nodes(spark):
    r = shapes.Validator(shapes.parse(PRE + SHAPES)).results(graph(spark, "e:a e:b e:c ."))
    assert r.count() == 0 and rows(shapes.conforms(r, graph(spark, "e:a e:b e:c ."))) == [("g", True)]


def test_clean(spark):
    g = graph(spark, """e:p a owl:DatatypeProperty . e:x e:p e:y ; e:q "abc"^^xsd:decimal, "1"^^xsd:integer .
      e:A rdfs:subClassOf [ a owl:Restriction ; owl:onProperty e:p ; owl:someValuesFrom e:B ], [ a owl:Restriction ; owl:onProperty e:p, e:q ; owl:someValuesFrom e:B ], [ a owl:Restriction ; owl:onProperty e:p ; owl:minCardinality 1 ], [ a owl:Restriction ; owl:onProperty e:p ; owl:hasValue "v" ] .""")
    fixed = rows(clean.coerce_literals(g).where("fixed"), "o", "o_kind", "o_dt")
    assert fixed == sorted([(E + "y", "lit", XSD + "string"), ("abc", "lit", None)], key=repr)
    assert clean.invalid_restrictions(g).count() == 2 and clean.invalid_restrictions(g, literal_cardinality_ok=True).count() == 1
    assert clean.strip_restrictions(g).where(F.col("o") == RESTRICTION).count() == 2
    assert rows(clean.missing_classes(graph(spark, "e:A rdfs:subClassOf e:B . e:B a owl:Class . e:C owl:disjointWith e:A .")), "s") == [(E + "A",), (E + "C",)]


def test_scores(spark):
    p, g = graph(spark, "e:Cash_Card a e:C . e:a e:b e:c ."), graph(spark, "e:CashCard a e:C . e:a e:b e:c . e:d e:e e:f .")
    assert rows(score.exact(p, g)) == [("g", 2, 3, 1, 0.5, 0.3333, 0.4)]
    assert rows(score.semantic(p, g)) == [("g", 2, 3, 2, 1.0, 0.6667, 0.8)]
    none = frame(spark, [])
    assert rows(score.exact(none, g)) == [("g", 0, 3, 0, 0.0, 0.0, 0.0)] and score.exact(none, none).count() == 0


def test_context(spark):
    g = graph(spark, 'e:A a owl:Class . e:p a owl:ObjectProperty ; rdfs:domain e:B, e:A . e:d a owl:DatatypeProperty ; rdfs:range xsd:string ; rdfs:label "d" .')
    assert rows(context.schema_context(g, {"e": E, "xsd": XSD}, E), "kind", "name", "domain", "range") == sorted([("class", "e:A", None, None), ("object", "e:p", "e:A", "(unspecified)"), ("data", "e:d", "(unspecified)", "xsd:string")], key=repr)
    assert rows(context.drift_samples(graph(spark, "<http://o/x> e:p <http://o/y> ."), E, 1), "iri") == [("http://o/x",)]
    assert rows(context.redundant_axioms(graph(spark, 'e:a e:src "1" . e:b e:src "1" . e:c e:src "2" .'), E + "src"), "axiom") == [(E + "a",), (E + "b",)]


def one(spark, c, text):
    return spark.createDataFrame([(text,)], "t string").select(c(F.col("t"))).first()[0]


@pytest.mark.parametrize("f, text, want", [
    (tx.slug, " a b--c ", "a_b_c"), (tx.slug, "", "Concept"), (tx.slug, None, "Concept"), (tx.slug, "9x", "C_9x"), (tx.normal_title, "Functional Requirement 13", "FR-13"), (tx.normal_title, "see fr_7", "FR-7"), (tx.normal_title, " Performance requirement 1 ", "Performance requirement 1"),
    (tx.strip_fence, "x ```turtle\na .\n``` y ```b```", "a ."), (tx.strip_fence, "  a . ", "a ."), (lambda c: tx.BANKING.term(c, "predicates"), "a dialog", "logs"), (lambda c: tx.BANKING.term(c, "subjects"), "The BANK customer", "Customer"), (lambda c: tx.BANKING.term(c, "objects"), "none", "RequirementTarget"),
    (lambda c: tx.normalize_prefix(c, "e", E + "#"), "@prefix e: <http://old#> .\ne:a e:b e:c .", f"@prefix e: <{E}#> .\ne:a e:b e:c ."), (lambda c: tx.normalize_prefix(c, "e", "http://old#"), "@prefix e: <http://old/> .\nx", "@prefix e: <http://old/> .\nx"), (lambda c: tx.normalize_prefix(c, "e", E), "x", f"@prefix e: <{E}> .\nx"),
])
def test_text_rules(spark, f, text, want):
    assert one(spark, f, text) == want


def test_repaired_lines(spark):
    cases = [("e:a '^b'[ ?e:x 'e:y ^e:z ;", "e:a [ e:x e:y e:z ;"), ("  e:p a e:q ;", "  e:p e:q ;"), ("# c", "# c"), ("  e:r a e:s .", "  e:r e:s ."), ("e:r a e:s .", "e:r a e:s ."), ("a -> b ;", "# a -> b ;"), ("NOT x", "# NOT x"), ("e:r a e:s .", "e:r a e:s ."), ("e:a rdfs:range xsd:decimal ;", "e:a rdfs:range ;"), ("e:a e:b 5.5^^xsd:decimal .", 'e:a e:b "5.5"^^xsd:decimal .'), ("\x01e:a", "e:a")]
    df = spark.createDataFrame([("d", i, a) for i, (a, _) in enumerate(cases)], "doc string, line_no int, text string")
    assert [r[0] for r in tx.repaired_lines(df).orderBy("line_no").select("text").collect()] == [b for _, b in cases]
    assert rows(tx.repaired(spark.createDataFrame([("d", "b'e:a\\ne:b'")], "doc string, text string")), "text") == [("e:a\ne:b",)]


def test_requirements(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('// c\n{"title": "Functional requirement 1", "text": " t "}\n,\n{"id": "X",\n "text": "u"}\n\n{"boilerplate": {"prefix": "p", "main": "", "suffix": "s"}}')
    r = req.read(spark, str(tmp_path / "a.jsonl"))
    assert rows(r, "ord", "identifier", "title", "text", "boilerplate") == [(1, "FR-1", "Functional requirement 1", "t", ""), (2, "X", "Requirement 2", "u", ""), (3, "REQ-003", "Requirement 3", "", "p \ns")]
    assert req.read(spark, str(tmp_path / "a.jsonl"), limit=1).count() == 1
    assert req.lenient_records('[{"a": 1}]') == [{"a": 1}] and req.lenient_records("") == [] and req.lenient_records('{"a": 1}') == [{"a": 1}]
    with pytest.raises(ValueError):
        req.lenient_records('{"a": 1}\n{"b": ')
    (tmp_path / "dev.txt").write_text("FR-1\n\nQ\n")
    ids = req.split_ids(spark, str(tmp_path / "dev.txt"))
    assert rows(req.assigned(r, {"dev": ids}), "ord", "split") == [(1, "dev"), (2, None), (3, None)] and rows(req.unmatched(r, ids)) == [("Q",)]
    assert req.split_ids(spark, str(tmp_path / "no")).count() == 0 and rows(req.batches(r, 2), "batch") == [(0,), (0,), (1,)]


def test_result_patches(spark):
    cols = "graph_id string, result_id int, focus_node string, path string, value string, message string, source_shape string, severity string"
    data = [("g", 2, "f", "p", "v", "second", "s", "sh:Violation"), ("g", 1, "f", "p", "v", "first", "s", "violation"), ("g", 3, None, "", None, None, None, "VIOLATION"), ("g", 4, "f", "q", "v", "m", "s", "sh:Warning"), ("h", 5, "f", "q", "v", "m", "s", None)]
    df = spark.createDataFrame(data, cols)
    got = rows(repair.from_results(df, ["graph_id"], ["result_id"]), "graph_id", "subject", "predicate", "object", "message")
    assert got == sorted([("g", "f", "p", "v", "first"), ("g", repair.NO_FOCUS, repair.NO_PATH, repair.NO_VALUE, None)], key=repr)
    assert repair.from_results(df, ["graph_id"], ["result_id"], True).count() == 3


def test_applied_patches(spark):
    df = spark.createDataFrame([("g", "addProperty", "A", "e:p", "xsd:string", "m"), ("g", "subclass", "e:A", "x", "e:B", None), ("g", "assert", "e:i", "e:p", "text", None), ("g", "assert", "e:i", "e:p", "e:j", None), ("g", "unknown", "e:A", "e:o", "e:B", None), ("g", None, None, None, None, None)], "graph_id string, action string, subject string, predicate string, object string, message string")
    got = {r[1:] for r in rows(repair.applied(df, "http://b#", {"e": E}), "graph_id", "s", "p", "o", "o_kind")}
    assert (E + "A", SUBCLASS, E + "B", "iri") in got and (E + "i", E + "p", "text", "lit") in got and (E + "i", E + "p", E + "j", "iri") in got and (E + "o", TYPE, OWL + "ObjectProperty", "iri") in got and (E + "p", TYPE, OWL + "DatatypeProperty", "iri") in got and ("http://b#UnknownSubject", TYPE, CLASS, "iri") in got


def test_stop_rules():
    s = repair.should_stop
    assert s("max_only", 3, 3, 5, 1, 0.8, 0, True).reason == "max_iterations_reached" and not s("max_only", 2, 3, 0, 1, 0.8, 0, True).stop
    assert s("default", 0, 3, None, 0, 0.8, 5, False).reason == "no_hard_violations" and s("ignore_no_hard", 0, 3, 0, 0, 0.8, 0, False).reason == "no_patches_available"
    assert s("hard_and_cq", 0, 3, 1, 0.9, 0.8, 2, True).reason == "patches_unchanged" and s("hard_and_cq", 0, 3, 1, 0.9, 0.8, 2, False).reason == "cq_threshold_met"
    with pytest.raises(ValueError):
        s("other", 0, 1, 0, 0, 0, 0, False)


def test_draft_and_loop(spark):
    r = spark.createDataFrame([("g", "FR-1", "The customer shall verify the card"), ("g", None, None)], "graph_id string, identifier string, text string")
    gen = drafting.RuleGenerator(tx.BANKING, E)
    d = gen.draft(r)
    assert d.count() == 14 - 0 and d.where(F.col("p") == E + "sourceRequirement").count() == 2
    assert gen.repair(spark.createDataFrame([("g", 1, 'Foo | "x"'), ("g", 2, "")], "graph_id string, idx int, prompt string")).count() == 6
    cons = [shapes.Constraint(E + "S", OWL + "Axiom", E + "missing", False, "minCount", "1", "Violation", "m")]
    q = [f"PREFIX atm: <{E}> PREFIX rdfs: <{RDFS}>\nASK {{ atm:holds rdfs:domain atm:Bank ; rdfs:range atm:Vault }}"]
    final, log = loop.run(d, cons, q, loop.LoopConfig(base=E, policy="ignore_no_hard", prefixes={"atm": E}, max_iterations=2, infer=False))
    got = rows(log, "iteration", "hard", "cq_pass_rate", "stop", "reason")
    assert got[0] == (0, 2, 0.0, False, "continue") and got[-1][1:3] == (2, 1.0) and got[-1][3]
    assert final.where(F.col("s") == E + "holds").count() == 3
    with pytest.raises(ValueError):
        loop.LoopConfig(base=E, policy="x")


def test_merge_is_a_set(spark):
    g = graph(spark, "e:a e:b e:c .")
    assert merged(g, g).count() == 1


def test_unique_key_of_several_values(spark):
    g = graph(spark, 'e:a a e:T ; e:k 1, 2 ; e:d "x", "y" . e:b a e:T ; e:k 2 ; e:d "y" . e:c a e:T ; e:k 2 ; e:d "z" . e:d a e:T ; e:k 2 . e:f a e:U ; e:k 2 ; e:d "z" .')
    unique = lambda *paths: [r[0] for r in rows(shapes.Validator([shapes.Constraint(E + "S", E + "T", "", False, "uniqueKey", " ".join(E + p for p in paths))]).results(g), "focus_node")]
    assert unique("k", "d") == [E + "a", E + "b"] and unique("k") == [E + x for x in "abcd"] and unique("d") == [E + "a", E + "b"]


def test_question_patches_settle_in_order(spark):
    """A later question takes what earlier ones left, also where several expect the same."""
    dr, sub = "ASK { e:p rdfs:domain e:A ; rdfs:range xsd:string }", "ASK { e:A rdfs:subClassOf+ e:B . e:A rdfs:subClassOf e:C }"
    qs = [("g", 1, dr), ("g", 2, dr), ("g", 3, sub), ("g", 4, sub), ("g", 5, sub), ("g", 6, "ASK { ?x a e:D . ?x e:q ?y }"), ("g", 7, "ASK { ?x a e:D }"), ("g", 8, None), ("h", 2, sub), ("h", 1, "ASK { e:A rdfs:subClassOf e:B }"), ("h", None, dr)]
    got = rows(repair.from_questions(spark.createDataFrame(qs, "graph_id string, cq_id int, query string"), "e"), "graph_id", "action", "subject", "predicate", "object")
    sc = "rdfs:subClassOf"
    # Question 2 expects a property that is taken, so its first two names are a pair; the fifth has nothing left but that of its names.
    assert got == sorted([("g", "addProperty", "e:A", "e:p", "xsd:string"), ("g", "addSubclass", "e:p", sc, "e:A"), ("g", "addSubclass", "e:A", sc, "e:B"), ("g", "addSubclass", "e:A", sc, "e:C"), ("g", "addSubclass", "e:D", sc, "e:q"), ("h", "addSubclass", "e:A", sc, "e:B"), ("h", "addSubclass", "e:A", sc, "e:C")], key=repr)
    assert repair.from_questions(spark.createDataFrame([], "graph_id string, cq_id int, query string")).count() == 0


def test_slug_and_arrow_lines(spark):
    assert one(spark, tx.slug, "Größe über 9") == "Gr_e_ber_9"
    df = spark.createDataFrame([("d", 1, "5^^xsd:decimal -> x"), ("d", 2, "NOT 5^^xsd:decimal"), ("d", 3, "e:a 'e:b '^b'e:c ; ^^xsd:x")], "doc string, line_no int, text string")
    assert rows(tx.repaired_lines(df), "line_no", "text") == [(1, "# 5^^xsd:decimal -> x"), (2, '# NOT "5"^^xsd:decimal'), (3, "e:a e:b e:c ; ^^xsd:x")]


def test_long_chains_and_lists(spark):
    """A closure of a thousand steps and a list of a thousand members end by themselves."""
    n = 1000
    chain = spark.range(n).select(F.lit("g").alias("graph_id"), F.concat(F.lit("n"), "id").alias("s"), F.concat(F.lit("n"), (F.col("id") + 1).cast("string")).alias("o"))
    assert closure.transitive(chain).count() == n * (n + 1) // 2
    node = lambda c: F.concat(F.lit("_:l"), c.cast("string"))
    none = F.lit(None).cast("string")
    cell = lambda p, o, kind: spark.range(n).select(F.lit("g").alias("graph_id"), node(F.col("id")).alias("s"), F.lit("bnode").alias("s_kind"), F.lit(RDF + p).alias("p"), o.alias("o"), kind.alias("o_kind"), none.alias("o_dt"), none.alias("o_lang"))
    last = F.col("id") == n - 1
    g = cell("first", F.concat(F.lit("m"), F.col("id").cast("string")), F.lit("iri")).unionByName(cell("rest", F.when(last, RDF + "nil").otherwise(node(F.col("id") + 1)), F.when(last, "iri").otherwise("bnode")))
    got = closure.whole_lists(g)
    assert got.count() == n and got.select("list").distinct().collect()[0][0] == "_:l0"
    ring = frame(spark, [("g", "_:a", "bnode", RDF + "rest", "_:b", "bnode", None, None), ("g", "_:b", "bnode", RDF + "rest", "_:a", "bnode", None, None), ("g", "_:a", "bnode", RDF + "first", "x", "iri", None, None)])
    assert closure.whole_lists(ring).count() == 0 and closure.whole_lists(ring.limit(0)).count() == 0
    one_ = frame(spark, [("g", "_:a", "bnode", RDF + "rest", RDF + "nil", "iri", None, None), ("g", "_:a", "bnode", RDF + "first", "x", "iri", None, None)])
    assert rows(closure.whole_lists(one_)) == [("g", "_:a", "x")]


def test_bounds_lists_and_decimals(spark):
    x = "http://e#"
    g = frame(spark, [r for i, (o, dt) in enumerate((("in use", "string"), ("free", "string"), ("in", "string"), ("2024-05-01", "date"), ("2023-05-01", "date"), ("1" + "0" * 25, "integer"), ("5", "decimal"))) for r in (("g", f"{x}{i}", "iri", TYPE, x + "T", "iri", None, None), ("g", f"{x}{i}", "iri", x + "p", o, "lit", XSD + dt, None))])
    c = lambda comp, arg: shapes.Constraint(x + comp, x + "T", x + "p", False, comp, arg)
    broken = lambda comp, arg: sorted(r[0][-1] for r in shapes.Validator([c(comp, arg)]).results(g).select("focus_node").collect())
    assert broken("in", '["in use", "free"]') == ["2", "3", "4", "5", "6"]
    assert broken("minInclusive", "2024-01-01") == ["0", "1", "2", "4", "5", "6"]
    assert broken("maxInclusive", "100") == ["0", "1", "2", "3", "4", "5"]
    assert broken("minExclusive", "1e24") == ["0", "1", "2", "3", "4", "6"]
    parsed = shapes.parse(f'@prefix sh: <http://www.w3.org/ns/shacl#> . <{x}S> sh:targetClass <{x}T> ; sh:property [ sh:path <{x}p> ; sh:in ( "in use" "free" ) ] .')
    assert [p.arg for p in parsed] == ['["in use", "free"]']
    bad = merged(g, frame(spark, [("b", x + "b", "iri", TYPE, x + "T", "iri", None, None), ("b", x + "b", "iri", x + "p", "5,0", "lit", XSD + "decimal", None)]))
    res, no = shapes.validated([c("maxInclusive", "100")], bad)
    assert rows(no) == [("b",)] and {r.graph_id for r in res.collect()} == {"g"}
    assert rows(shapes.conforms(res, bad, no)) == [("b", False), ("g", False)]
    assert shapes.Validator([]).results(g).count() == 0


def test_date_times(spark):
    from graphloom.functions import literals

    ok = lambda v: spark.range(1).select(literals.well_formed(F.lit(v), F.lit(XSD + "dateTime"))).first()[0]
    assert [ok(v) for v in ("2024-02-29T10:00:00", "2023-02-29T10:00:00", "2024-01-01T24:00:00Z", "2024-02-31T00:00:00", "2024-01-01")] == [True, False, True, False, False]


def test_formats(spark, tmp_path):
    from graphloom.sources import formats

    assert [formats.guess(p) for p in ("a.TTL", "b.owl", "c.nt", "d.nq", "e.txt")] == ["turtle", "xml", "nt", "nquads", None]
    e = "http://e/"
    doc = f"""<rdf:RDF xmlns:rdf="{RDF}" xmlns:e="{e}" xml:base="{e}x">
      <e:C rdf:about="{e}a" e:note="n"><e:p rdf:resource="b"/><e:q rdf:datatype="{XSD}integer">5</e:q><e:l xml:lang="EN">t</e:l>
        <e:n><rdf:Description rdf:ID="c"/></e:n><e:items rdf:parseType="Collection"><e:C rdf:about="{e}i"/></e:items><e:r rdf:parseType="Resource"><e:s>v</e:s></e:r></e:C></rdf:RDF>"""
    got = {r[1:] for r in formats.parse_xml(doc)}
    assert {(e + "a", "iri", TYPE, e + "C", "iri", None, None), (e + "a", "iri", e + "p", e + "b", "iri", None, None), (e + "a", "iri", e + "q", "5", "lit", XSD + "integer", None), (e + "a", "iri", e + "l", "t", "lit", RDF + "langString", "en"),
            (e + "a", "iri", e + "n", e + "x#c", "iri", None, None), (e + "a", "iri", e + "note", "n", "lit", XSD + "string", None), ("_:g_x1", "bnode", RDF + "first", e + "i", "iri", None, None), ("_:g_x1", "bnode", RDF + "rest", RDF + "nil", "iri", None, None)} <= got and len(got) == 12
    assert formats.parse_xml("") == []
    with pytest.raises(formats.XmlError):
        formats.parse_xml("<a>")
    (tmp_path / "x.rdf").write_text(doc)
    (tmp_path / "y.ttl").write_text("@prefix e: <http://e/> . e:a e:p e:b .")
    (tmp_path / "z.nq").write_text(f'<{e}a> <{e}p> "x <y> . z" <{e}g> .\n<{e}a> <{e}p> <{e}b> .\n# c\n')
    assert formats.load(spark, str(tmp_path / "x.rdf")).count() == 12
    assert rows(formats.load(spark, str(tmp_path / "y.ttl")), "graph_id", "s", "o") == [("y", e + "a", e + "b")]
    assert rows(formats.load(spark, str(tmp_path / "z.nq")), "graph_id", "o") == [(e + "g", "x <y> . z"), ("z", e + "b")]
    (tmp_path / "bad.ttl").write_text("e:a e:b")
    assert formats.load(spark, str(tmp_path / "bad.ttl"), strict=False).count() == 0


def test_turtle_lines_and_report_graph(spark):
    from graphloom.plans import report

    g = frame(spark, [("g", "http://e/a", "iri", TYPE, "http://e/C", "iri", None, None), ("g", "http://e/a", "iri", "http://e/p", 'q"\n', "lit", XSD + "string", None), ("g", "_:x", "bnode", "http://e/p", "5", "lit", XSD + "integer", None)])
    text = "\n".join(r.line for r in turtle.turtle_lines(g, {"e": "http://e/"}).collect())
    assert {r[1:] for r in turtle.parse(text)} == {tuple(r)[1:] for r in frame(spark, [(a, s.replace("_:x", "_:g_1"), *rest) for a, s, *rest in (tuple(r) for r in g.collect())]).collect()}
    res = spark.createDataFrame([("g", "f", "p", "m", "Violation", "s", "c", "v"), ("g", "f", None, "m", None, "s", "c", None)], ", ".join(f"{c} string" for c in shapes.RESULT))
    out = report.report_graph(g.unionByName(g.withColumn("graph_id", F.lit("h"))), res)
    assert {r[0]: r[1] for r in rows(out.where(F.col("p").endswith("conforms")), "graph_id", "o")} == {"g": "false", "h": "true"}
    assert out.where(F.col("p").endswith("#result")).count() == 2 and out.where(F.col("p").endswith("#value")).count() == 1
    assert report.report_lines(g, res).count() == 3


def test_loops_with_a_generator(spark):
    x = "http://e#"
    g = frame(spark, [("a", x + "n1", "iri", TYPE, x + "T", "iri", None, None), ("b", x + "n2", "iri", TYPE, x + "T", "iri", None, None), ("c", x + "n3", "iri", TYPE, x + "T", "iri", None, None), ("c", x + "n3", "iri", x + "p", "v", "lit", None, None)])
    cons = [shapes.Constraint(x + "S", x + "T", x + "p", False, "minCount", "1", "Violation", "a value")]

    def answer(patches):
        return patches.select("graph_id").distinct().select("graph_id", F.when(F.col("graph_id") == "a", F.lit('```turtle\ne:n1 e:p "v" .\n```')).otherwise("no turtle at all").alias("turtle"))

    final, log = loop.run(g, cons, [], loop.LoopConfig(base=x, prefix="e", prefixes={"e": x}, max_iterations=2, infer=False), answer)
    last = {r.graph_id: r.reason for r in log.orderBy("iteration").collect()}
    assert last["a"] == last["c"] == "no_hard_violations" and last["b"] in ("patches_unchanged", "max_iterations_reached")
    assert final.where("graph_id = 'b'").count() > 1  # the rules stood in for the text
    delta, lost = loop.applied(spark.createDataFrame([("z", "addProperty", None, None, None, "m")], "graph_id string, action string, subject string, predicate string, object string, message string").where("false"), loop.LoopConfig(base=x), answer)
    assert delta.count() == lost.count() == 0

    gen = drafting.RuleGenerator(tx.BANKING, x)
    final, log = loop.by_prompts(g, cons, gen, most=2, infer=False)
    assert {(r.graph_id, r.iteration): r.conforms for r in log.collect()} == {("a", 0): False, ("b", 0): False, ("c", 0): True, ("a", 1): False, ("b", 1): False, ("a", 2): False, ("b", 2): False}
    assert final.where((F.col("graph_id") == "a") & F.col("s").contains("_repair_")).select("s").distinct().count() == 1


def test_prompts_with_axioms(spark):
    ex = spark.createDataFrame([(1, "R1", "t", ({"e": "http://e#"}, ["e:A a owl:Class ."], None)), (2, "R2", "u", None)], "ord int, identifier string, text string, axioms struct<prefixes:map<string,string>,tbox:array<string>,abox:array<string>>")
    assert rows(drafting.axioms_text(ex)) == [(1, "- [R1] t\n@prefix e: <http://e#> .\ne:A a owl:Class ."), (2, "- [R2] u")]
    p = drafting.draft_prompt(spark.createDataFrame([(0, 1, "A", "x")], "batch int, ord int, identifier string, text string"), "ctx", ex).first().prompt
    assert "e:A a owl:Class ." in p and p.endswith("C. Requirements\n- [A] x")
    graphs = spark.createDataFrame([("g", "x" * 7000)], "graph_id string, turtle string")
    r = drafting.repair_request(spark.createDataFrame([("g", "b"), ("g", "a")], "graph_id string, prompt string"), graphs).first().request
    assert r.startswith("Repair these results:\n- a\n- b\n") and r.endswith("x" * 4000) and "x" * 4001 not in r
    a = drafting.apply_request(spark.createDataFrame([("g", "addProperty", "s", "p", "o", "m")], "graph_id string, action string, subject string, predicate string, object string, message string"), graphs).first().request
    assert '"subject":"s"' in a and a.endswith("x" * 6000)
