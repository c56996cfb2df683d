"""Whole runs, the command line, the entry point and streams."""

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

import __spark_entry__
from graphloom import cli
from graphloom.model import SCHEMA, XSD
from graphloom.operators.shapes import Constraint
from graphloom.plans import pipeline, report
from graphloom.streaming import validation

SHAPES = "@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix ex: <http://e.org/o#> . @prefix owl: <http://www.w3.org/2002/07/owl#> .\nex:S sh:targetClass owl:Axiom ; sh:property [ sh:path ex:sourceRequirement ; sh:minCount 1 ] ."
QUESTIONS = "PREFIX ex: <http://e.org/o#>\nPREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#>\nASK { ex:opens rdfs:domain ex:Bank ; rdfs:range ex:Vault }\n"
GOLD = "@prefix ex: <http://e.org/o#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .\nex:opens rdfs:domain ex:Bank ; rdfs:range ex:Vault ."


@pytest.fixture
def config(tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"title": "Functional requirement 1", "text": "The bank shall log the account"}, {"title": "Functional requirement 2", "text": "The customer shall verify the card"}]))
    for n, t in (("s.ttl", SHAPES), ("q.rq", QUESTIONS), ("g.ttl", GOLD), ("dev.txt", "FR-1\n")):
        (tmp_path / n).write_text(t)
    c = {"requirements": str(tmp_path / "r.json"), "base": "http://e.org/o", "shapes": str(tmp_path / "s.ttl"), "questions": str(tmp_path / "q.rq"), "gold": str(tmp_path / "g.ttl"), "splits": {"dev": str(tmp_path / "dev.txt")}, "domains": [{"name": "d"}], "policies": "ignore_no_hard", "max_iterations": 2}
    (tmp_path / "c.json").write_text(json.dumps(c))
    return tmp_path


def test_run(spark, config):
    (c,) = pipeline.load_config(str(config / "c.json"), output=str(config / "out"))
    t = pipeline.run(spark, c)
    assert rows(t["requirements"], "identifier", "split", "batch") == [("FR-1", "dev", 0), ("FR-2", None, 0)]
    assert t["draft"].count() == 14 and rows(t["draft_exact"], "gold", "overlap") == [(2, 0)]
    log = rows(t["ignore_no_hard_log"], "iteration", "cq_pass_rate", "reason")
    assert log[0] == (0, 0.0, "continue") and log[-1][1] == 1.0
    assert rows(t["ignore_no_hard_exact"], "recall") == [(1.0,)] and rows(t["ignore_no_hard_reasoner"], "consistent", "backend") == [(True, "rules")]
    assert json.loads(t["ignore_no_hard_report"].first().report)["questions"]["cq_passed"] == 1
    assert (config / "out/d/config.json").exists() and list((config / "out/d/ignore_no_hard_final.nt").glob("part-*"))


def test_config_errors(config):
    with pytest.raises(ValueError):
        pipeline.Config("d", "r", gold=str(config / "g.ttl"), vocabulary=str(config / "g.ttl"))
    with pytest.raises(ValueError):
        pipeline.Config("d", "r", max_iterations=0)
    (config / "x.json").write_text('{"name": "d", "requirements": "r", "nope": 1}')
    with pytest.raises(ValueError):
        pipeline.load_config(str(config / "x.json"))


def test_command_line(spark, config, capsys):
    assert cli.main(["run", str(config / "c.json"), "--draft-only"]) == 0 and "draft_exact" in capsys.readouterr().out
    assert cli.main(["query", "no_such", "x"]) == 2


def test_broken_turtle_is_repaired(spark):
    g = pipeline.read_turtle(spark, "```turtle\n@prefix e: <http://e#> .\ne:a e:b ?e:c .\nNOT this\n```", "g")
    assert rows(g, "s", "o") == [("http://e#a", "http://e#c")]


def test_entry(spark):
    q, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 60 and {f"p{i}_found" for i in (1, 4, 5, 6, 7)} <= set(q)


def test_stream(spark, tmp_path):
    data = [("g", "s", "iri", "p", v, "lit", XSD + "decimal", None) for v in ("1", "x", "-1", "9")]
    spark.createDataFrame(data, SCHEMA).withColumn("at", F.lit("2025-01-01 00:00:00").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    cons = [Constraint("s", "c", "p", False, "datatype", XSD + "decimal"), Constraint("s", "c", "p", False, "minInclusive", "0")]
    q = validation.counts(validation.bad_values(src, cons), "at").writeStream.outputMode("complete").format("memory").queryName("bad").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("bad"), "component", "n") == [("s|datatype", 1), ("s|minInclusive", 2)]


def test_report_holds_whole_lists(spark):
    v = spark.range(0, 2503).select(
        F.when(F.col("id") < 3, "small").when(F.col("id") == 3, F.lit(None)).otherwise("large").alias("graph_id"), F.format_string("n%05d", (F.col("id") * 7919) % 2503).alias("focus_node"),
        F.lit("p").alias("path"), F.lit("m").alias("message"), F.lit("Violation").alias("severity"), F.lit("s").alias("source_shape"), F.lit("c").alias("component"), F.col("id").cast("string").alias("value"),
    )
    graphs = spark.createDataFrame([("small",), ("large",), ("none",), (None,)], "graph_id string")
    answers = spark.createDataFrame([("none", 1, True, None), ("large", 1, False, "no")], "graph_id string, cq_id int, success boolean, message string")
    patches = spark.range(0, 1200).select(F.lit("small").alias("graph_id"), F.lit("add").alias("action"), F.format_string("s%04d", F.col("id")).alias("subject"), F.lit("p").alias("predicate"), F.lit("o").alias("object"))
    got = {(r.graph_id, r.part): json.loads(r.report) for r in report.report_json(graphs, v, answers, patches).collect()}
    assert sorted(got) == [("large", 1), ("large", 2), ("large", 3), ("none", 1), ("small", 1), ("small", 2)]
    large = [x for k in (1, 2, 3) for x in got["large", k]["results"]]
    want = sorted((r.focus_node, r.value) for r in v.where("graph_id = 'large'").collect())
    assert [(x["focus_node"], x["value"]) for x in large] == want and [len(got["large", k]["results"]) for k in (1, 2, 3)] == [1000, 1000, 499]
    assert got["large", 1]["validation"] == {"total": 2499, "hard": 2499, "soft": 0} and got["large", 1]["questions"]["cq_total"] == 1 and not {"validation", "questions"} & set(got["large", 2])
    assert [x["subject"] for k in (1, 2) for x in got["small", k]["patches"]] == [f"s{i:04d}" for i in range(1200)] and len(got["small", 1]["results"]) == 3 and "results" not in got["small", 2]
    assert got["none", 1]["validation"]["total"] == 0 and "results" not in got["none", 1] and got["none", 1]["parts"] == 1


def test_stream_checks_all_that_the_value_tells(spark):
    df = spark.createDataFrame([("g", "s", "iri", "p", v, "lit", XSD + "integer", None) for v in ("5", "123")] + [("g", "s", "iri", "p", "u", "iri", None, None)], SCHEMA)
    args = {"minExclusive": "5", "maxExclusive": "123", "minLength": "2", "maxLength": "2", "pattern": "^[0-9]$", "in": "5 6", "nodeKind": "http://www.w3.org/ns/shacl#Literal"}
    cons = [Constraint("s", "c", "p", False, k, v) for k, v in args.items()]
    want = [("minExclusive", "5"), ("minExclusive", "u"), ("maxExclusive", "123"), ("maxExclusive", "u"), ("minLength", "5"), ("minLength", "u"), ("maxLength", "123"), ("pattern", "123"), ("pattern", "u"), ("in", "123"), ("in", "u"), ("nodeKind", "u")]
    assert rows(validation.bad_values(df, cons), "component", "o") == sorted((f"s|{k}", v) for k, v in want)
    for c in (Constraint("s", "c", "p", False, "minCount", "1"), Constraint("s", "c", "p", True, "datatype", XSD + "string")):
        with pytest.raises(ValueError, match=c.component):
            validation.bad_values(df, [*cons, c])


def test_patched_triples_of_every_predicate(spark, tmp_path):
    data = [("g", "addTriple", "bnk:a", "bnk:coversClaim", "bnk:b", "m"), ("g", "assert", "bnk:a", "bnk:note", "text", "m"), ("g", "addProperty", "bnk:a", "bnk:size", "xsd:integer", "a size"), ("g", "addProperty", "bnk:a", "bnk:size", "xsd:integer", "the size")]
    spark.createDataFrame(data, "graph_id string, action string, subject string, predicate string, object string, message string").write.parquet(str(tmp_path / "patches.parquet"))
    got = {(r.p.split("#")[1], r.o_kind): r.n for r in __spark_entry__.queries()["patched_triples"](spark, str(tmp_path)).collect()}
    assert got == {("coversClaim", "iri"): 1, ("note", "lit"): 1, ("domain", "iri"): 1, ("range", "iri"): 1, ("label", "lit"): 2, ("type", "iri"): 2}
    assert "label" in __spark_entry__.oracle_sql()["patched_triples"]


def test_repair_loop_over_segments(spark, tmp_path):
    spark.createDataFrame([(i, i % 3, "A" if i < 3 else "B") for i in range(5)] + [(9, 1, None)], "c_custkey bigint, c_nationkey int, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    log = __spark_entry__.queries()["repair_loop_segments"](spark, str(tmp_path))
    got = {(r.graph_id, r.iteration): (r.hard, r.patch_count, r.reason) for r in log.collect()}
    assert got == {(g, i): (n, n + 2 - (i > 0), "patches_unchanged" if i == 2 else "continue") for g, n in (("A", 3), ("B", 2)) for i in range(3)}
