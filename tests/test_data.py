"""General data operators: small tables with nulls, ties, repeats, empties and clashing names."""

import datetime
import json
import random

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.common import numbered, pick
from graphloom.operators import badrows, copies, drift, nested, terms


def logs(spark, *payloads):
    return spark.createDataFrame([(i, p if isinstance(p, (str, type(None))) else json.dumps(p), "x", "y") for i, p in enumerate(payloads)], "log_id bigint, payload string, Tbl string, member string")


def test_nested_children(spark):
    doc = {"iteration_log": [
        {"cq": {"results": [{"query": "a"}, None, {"query": "b"}, {}, "text", [{"query": "c"}]]}, "shacl": {"violations": {"hard": 1, "soft": None}}, "patches": {"types": {"addProperty": 0, "assert": {"n": 1}}}},
        None, {"cq": {"results": {"query": "alone"}}, "shacl": None}, 7]}
    alone = {"iteration_log": {"cq": {"results": None}, "shacl": {"violations": {"hard": 2}}}}
    got = rows(nested.children(nested.shred_runs(logs(spark, doc, alone, None, "no json", [1], {}, "null"))))
    assert got == sorted([
        (0, 0, "cq_result", "0"), (0, 0, "cq_result", "2"), (0, 0, "cq_result", "3"), (0, 0, "violation", "hard"), (0, 0, "patch_type", "addProperty"), (0, 0, "patch_type", "assert"),
        (0, 2, "cq_result", "0"), (1, 0, "violation", "hard")], key=repr)


def test_nested_tables_keep_links(spark):
    doc = {"run": "r", "iteration_log": [{"iteration": 5, "cq": {"results": [{"query": "q", "success": True}]}}]}
    t = nested.run_tables(logs(spark, doc))
    assert rows(t["runs"]) == [(0, "r", None, None)]
    assert rows(t["cq_results"]) == [(0, 0, 0, "q", True, None)]
    assert rows(t["iterations"], "log_id", "iter_pos", "iteration") == [(0, 0, 5)]


def test_nested_round_trip_of_values(spark):
    rng = random.Random(1)
    docs = [{"a": [{"x": rng.randrange(9), "y": [{"z": str(rng.random())} for _ in range(rng.randrange(3))]} for _ in range(rng.randrange(4))]} for _ in range(20)]
    r = nested.shred(logs(spark, *docs), "log_id", "payload")
    got = rows(nested.pivot(r, "a[].y[]", ["z"]).select("rec_id", "ordinals", "z"))
    assert got == sorted(((i, [j, k], y["z"]) for i, d in enumerate(docs) for j, x in enumerate(d["a"]) for k, y in enumerate(x["y"])), key=repr)


def test_nested_errors_are_kept(spark):
    assert rows(nested.shred_runs(logs(spark, "{")), "tbl") == [("_error",)]


def test_nested_stream_is_the_parser():
    """Read as a stream or as a whole, a text gives the same triples, or neither is JSON."""
    rep, key = frozenset(["a", "b.c"]), frozenset(["a[].k", "k"])
    good = ['{}', ' { "a" : [ ] , "b" : {"c": {"d": 1}}, "k": {"x": null, "y": 2} } ', '{"a":[{"k":{"p":1}},null,[1,[2]],"t",{"z":[{"q":1}]}],"e\\u0041":true}', '[1,{"a":2}]', '"x"', '12', 'null', '{"a":{"k":{"p":1}}}', '{"a":"\\ud83d\\ude00","n":NaN}']
    for t in good:
        assert sorted(map(repr, nested.triples(t, rep, key))) == sorted(map(repr, nested.walk(json.loads(t), nested.ROOT, "", (), rep, key))), t
    for t in ("", "{", '{"a"}', '{"a":1,}', '{"a":[1,]}', '{"a":[1 2]}', '{"a":1} x', "{'a':1}", '{"a":1 "b":2}', "nul", '{"a":"\n"}', '{"a":[1}'):
        with pytest.raises(ValueError):
            json.loads(t)
        with pytest.raises(ValueError):
            list(nested.triples(t, rep, key))


def test_nested_repeated_names(spark):
    df = spark.createDataFrame([(1, '{"iteration_log":[{"iteration":1}],"run":"a","iteration_log":[{"iteration":2},{"iteration":3}]}'), (2, '{"run":"b","x":')], "log_id bigint, payload string")
    out = nested.shred_runs(df)
    assert rows(out.where("tbl = 'iteration_log[]'").selectExpr("rec_id", "ordinals[0]", "vals['iteration']")) == [(1, 0, "2"), (1, 1, "3")]
    assert rows(out.where("rec_id = 2").select("tbl")) == [("_error",)]


def test_empty_tables(spark):
    assert nested.children(nested.shred_runs(logs(spark).limit(0) if False else spark.createDataFrame([], "log_id bigint, payload string"))).count() == 0
    assert copies.found(spark.createDataFrame([], "rec_id bigint, payload string")).count() == 0
    assert drift.changes(spark.createDataFrame([], "file_id bigint, series_id string, file_written_at timestamp_ntz, line_no int, payload string")).count() == 0
    assert badrows.found(spark.createDataFrame([], "line_id bigint, raw_line string"), spark.createDataFrame([], "response_id bigint, turtle string")).count() == 0
    e = spark.createDataFrame([], "patch_id bigint, source_shape string"), spark.createDataFrame([], "result_id bigint, constraint_component string, path string")
    assert terms.marked(terms.field_terms(*e)).count() == 0


def test_pick_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", "b")], "id int, text string, x string").toDF("id", "text", "TEXT")
    assert rows(pick(df, "id", "TEXT")) == [(1, "b")]


def test_copies(spark):
    recs = [
        {"title": "FR 1", "text": "The card, again."}, {"text": "the CARD again", "title": "fr-1", "z": 1}, {"title": None, "text": "x y"}, {"text": "XY"}, {"title": "", "text": "x-y"}, {"title": "x", "text": "y"},
        {"title": "Fr1", "text": "The car, dagain."}, "broken {", None, {}, {"other": 1}, {"title": "É", "text": "ß 1"}, {"title": "é", "text": "ß1"}, {"title": "act", "text": "n"}, {"title": "cat", "text": "n"},
    ]
    df = spark.createDataFrame([(i, r if isinstance(r, (str, type(None))) else json.dumps(r), "c") for i, r in enumerate(recs)], "rec_id bigint, payload string, key string")
    assert rows(copies.found(df)) == sorted([(0, 1), (0, 6), (2, 3), (2, 4), (9, 10), (11, 12)], key=repr)
    assert rows(copies.collapsed(df)) == sorted([(0, 3), (2, 3), (9, 2), (11, 2)], key=repr)


def test_copies_hot_group(spark):
    df = spark.range(3000).select(F.col("id").alias("rec_id"), F.when(F.col("id") % 3 == 0, '{"title": "Hot", "text": "a-b"}').otherwise(F.concat(F.lit('{"text": "'), F.col("id").cast("string"), F.lit('"}'))).alias("payload"))
    got = copies.found(df)
    assert got.count() == 999 and rows(got.select("keep_id").distinct()) == [(0,)]


def line(*a):
    return ",".join(a)


GOOD = ("12", "t", "text", "dev", "2024-02-29", "3")


def brute_line(s):
    if s is None:
        return "column_count"
    fields, i = [], 0
    while True:
        if s[i : i + 1] == '"':
            i, buf = i + 1, ""
            while True:
                j = s.find('"', i)
                if j < 0:
                    return "quoting"
                buf += s[i:j]
                if s[j + 1 : j + 2] == '"':
                    buf, i = buf + '"', j + 2
                    continue
                i = j + 1
                break
            if i < len(s) and s[i] != ",":
                return "quoting"
        else:
            j = s.find(",", i)
            j = len(s) if j < 0 else j
            buf, i = s[i:j], j
            if '"' in buf:
                return "quoting"
        fields.append(buf)
        if i >= len(s):
            break
        i += 1
    if len(fields) != 6:
        return "column_count"
    n, _, t, sp, d, p = fields
    ok = n.isascii() and n.isdigit() and t.strip() and sp in ("train", "dev", "test", "") and p in "12345" and len(p) == 1
    try:
        ok = ok and len(d) == 10 and d[4] == d[7] == "-" and bool(datetime.date.fromisoformat(d))
    except ValueError:
        ok = False
    return None if ok else "invalid_value"


CASES = [
    line(*GOOD), line("", *GOOD[1:]), line(*GOOD[:5]), line(*GOOD, ""), line(*GOOD[:4], "2023-02-29", "3"), line(*GOOD[:4], "2024-2-9", "3"), line(*GOOD[:5], "6"), line(*GOOD[:2], '"a, ""b""\nc"', *GOOD[3:]), line(*GOOD[:2], '"a"b', *GOOD[3:]),
    line(*GOOD[:2], 'a"b', *GOOD[3:]), line(*GOOD[:2], '"a', *GOOD[3:]), line(*GOOD[:2], '" "', *GOOD[3:]), line(*GOOD[:2], "", *GOOD[3:]), '"12","t","x","","2024-01-01","1"', "", None, '"', '""', ",,,,,", '12,t,"x" ,dev,2024-01-01,1', "x" * 50_000, '"' + 'a""' * 20_000 + '"',
    line("١", *GOOD[1:]), line(*GOOD[:3], "Dev", *GOOD[4:]), line(*GOOD[:4], "0000-01-01", "1"), line("12", "", *GOOD[2:]),
]


def test_bad_lines(spark):
    df = spark.createDataFrame([(i, c, "k") for i, c in enumerate(CASES)], "line_id bigint, raw_line string, reason string")
    got = dict(rows(badrows.read_lines(df), "row_id", "reason"))
    assert got == {i: brute_line(c) for i, c in enumerate(CASES)}
    assert dict(rows(badrows.read_lines(df, bad_only=True))) == {i: r for i, r in got.items() if r}
    loaded = {r[0]: r[1:] for r in rows(badrows.read_lines(df).where("reason is null"), "row_id", *badrows.COLUMNS)}
    assert loaded[7] == ("12", "t", 'a, "b"\nc', "dev", datetime.date(2024, 2, 29), 3)
    assert loaded[13] == ("12", "t", "x", "", datetime.date(2024, 1, 1), 1)


def test_bad_lines_at_random(spark):
    rng = random.Random(3)
    pieces = ["12", "t", '"', '""', ",", "a b", "\n", "dev", "2024-01-01", "3", '"x"', " "]
    cases = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14))) for _ in range(3000)] + [",".join(rng.choice(['"a"', "1", '"', "dev", "2024-01-01", "2", '"q""r"']) for _ in range(6)) for _ in range(1000)]
    df = spark.createDataFrame(list(enumerate(cases)), "line_id bigint, raw_line string")
    got = dict(rows(badrows.read_lines(df), "row_id", "reason"))
    assert [(cases[i], r) for i, r in got.items() if r != brute_line(cases[i])] == []


TURTLE = [
    ("a:b c:d e:f .", None), ("", None), (None, None), ("# x\n@prefix a: <b .\n```turtle\n\n```", None), ('a b "x \\" y . z" .', None), ('a b "x .', "quoting"), ("a b <http://x .", "quoting"), ('a b "x"y .', "quoting"), ('a b c"d .', "quoting"),
    ('a b "x"@en .', None), ('a b "x"^^xsd:string .', None), ("a b c", "column_count"), ("a b .", "column_count"), ("a b c d .", "column_count"), ("a b c.", "column_count"), ('a b "1.5"^^xsd:decimal .', None), ('a b "1,5"^^xsd:decimal .', "invalid_value"),
    ('a b "1.5"^^xsd:integer .', "invalid_value"), ('a b "yes"^^xsd:boolean .', "invalid_value"), ('a b "2024-02-29T00:00:00Z"^^xsd:dateTime .', None), ('a b "2023-02-29T00:00:00Z"^^xsd:dateTime .', "invalid_value"), ('a b "2024-02-29"^^xsd:dateTime .', "invalid_value"),
    ('a b "x"^^xsd:integer .\na b "y .', "quoting"), ('a b "x"^^xsd:integer .\na b .', "column_count"), ('a b "ends \\" .', "quoting"), ('a b "' + "x" * 30_000 + '" .', None), ('a b "24:00"^^xsd:date .', None), (' a b "+.5"^^xsd:decimal . ', None),
]


def test_bad_turtle(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TURTLE)], "response_id bigint, turtle string")
    assert [(TURTLE[i][0], r) for i, r in rows(badrows.read_turtle(df), "row_id", "reason") if r != TURTLE[i][1]] == []


def test_drift(spark):
    t = lambda h: datetime.datetime(2024, 1, 1, h)
    files = [
        (1, 0, [{"a": {"x": 1, "y": None}, "k": 1}, {"a": {"y": "s"}}]), (2, 1, [{"a": {"x": "1", "y": "s"}, "k": 1}]), (3, 2, [{"a": {"z": "s", "x": "1"}, "k": 1}]), (4, 3, [{"a": {"x": "1", "q": 1}, "k": None}]), (5, 3, [{"a": {"q": 1, "x": "1", "e": {}}}, None]),
    ]
    data = [(f, "s1", "n", t(h), i, json.dumps(p) if p is not None else "bad") for f, h, ps in files for i, p in enumerate(ps)] + [(9, "s2", "n", t(1), 0, None), (10, "s2", "n", t(2), 0, '{"m": [1]}')]
    df = spark.createDataFrame(data, "file_id bigint, series_id string, file_name string, file_written_at timestamp_ntz, line_no int, payload string")
    assert rows(drift.changes(df)) == sorted([
        (2, "type_changed", "a.x", ""), (3, "renamed", "a.y", "a.z"), (4, "removed", "a.z", ""), (4, "added", "a.q", ""), (4, "removed", "k", ""), (10, "added", "m", ""),
    ], key=repr)
    assert drift.consistent(df).count() == len(data)


def test_consistent_keeps_every_value(spark):
    docs = [
        {"stop": {"reason": "a"}, "iteration": "no", "x": {"p": 1.5, "q": True}, "both": {"u": 1, "v": 2}}, {"stop": {"stopReason": "b"}, "x": {"P": 2.5, "q": "odd"}, "both": {"u": 1, "w": 3}},
        {"x": {"P": [1, "\u00e4"]}, "x_q": "clash", "both": {"v": 5, "w": 6}, "iteration": 7}, {"stop": {"why": "c", "reason": "d"}, "a\ud800": "\udc00"},
    ]
    lines = [json.dumps(d) for d in docs] + ["bad", None]
    data = [(i, "s", datetime.datetime(2024, 1, 1, i), 0, p) for i, p in enumerate(lines)]
    df = spark.createDataFrame(data, "file_id bigint, series_id string, file_written_at timestamp_ntz, line_no int, payload string")
    cat = drift.catalogue(df)
    chains = drift.columns(cat, drift.changes(df))
    assert chains["stop_reason"] == ("string", ["stop.reason", "stop.why", "stop.stopReason"]) and chains["x_p"][0] == "double" and sorted(chains["x_p"][1]) == ["x.P", "x.p"]
    assert not any({"both.v", "both.w"} <= set(ps) for _, ps in chains.values())  # renamed says the log, but both are in file 2
    got = {r.file_id: r for r in drift.consistent(df).collect()}
    assert [r for r in range(6) if got[r].raw != lines[r]] == [] and len(got) == 6
    assert [got[i].stop_reason for i in range(4)] == ["a", "b", None, "d"] and [got[i].x_p for i in range(3)] == [1.5, 2.5, None] and got[2].iteration == 7
    for i, d in enumerate(docs):  # each value is in its column or in rest
        for p, v in drift.leaves(d):
            c, ps = next((c, ps) for c, (_, ps) in chains.items() if p in ps)
            other = [q for q in ps if q != p and q in dict(drift.leaves(d))]
            assert p in got[i].rest or (got[i][c] is not None and not (other and all(q not in got[i].rest for q in other))), (i, p, v)
    assert got[0].rest == {"iteration": "no"} and got[2].rest == {"x.P": '[1, "\u00e4"]'} and got[3].rest == {"stop.why": "c"} and got[4].rest == {}


def test_drift_over_blocks(spark, monkeypatch):
    """A series over several blocks, against a comparison of neighbours; lifespans tile the files."""
    monkeypatch.setattr(drift, "BLOCK", 4)
    rng = random.Random(4)
    t0 = datetime.datetime(2024, 1, 1)
    docs = [{k: rng.choice([1, "s", True]) for k in "abc" if rng.random() < 0.7} | {"p": {k: 1 for k in "xy" if rng.random() < 0.5}} for _ in range(60)]
    data = [(i, "s" if i < 45 else "t", t0 + datetime.timedelta(hours=i), json.dumps(d)) for i, d in enumerate(docs)]
    df = spark.createDataFrame(data, "file_id bigint, series_id string, file_written_at timestamp_ntz, payload string")
    want = []
    for i in range(1, 60):
        if i == 45:
            continue
        old, new = (dict(drift.leaves(docs[j])) for j in (i - 1, i))
        out, come = set(old) - set(new), set(new) - set(old)
        want += [(i, "type_changed", f, "") for f in set(old) & set(new) if drift.kind_of(old[f]) != drift.kind_of(new[f])]
        for parent in ("", "p"):
            o, c = ([f for f in x if ("p" if "." in f else "") == parent] for x in (out, come))
            if len(o) == len(c) == 1 and drift.kind_of(old[o[0]]) == drift.kind_of(new[c[0]]):
                want.append((i, "renamed", o[0], c[0]))
            else:
                want += [(i, "removed", f, "") for f in o] + [(i, "added", f, "") for f in c]
    assert rows(drift.changes(df)) == sorted(want, key=repr)
    spans = rows(drift.lifespans(drift.catalogue(df)), "start_file", "end_file")
    assert sum(b - a + 1 for a, b in spans) == sum(len(dict(drift.leaves(d))) for d in docs)


def test_numbered(spark):
    df = spark.createDataFrame([(r,) for r in random.Random(6).sample(range(1000), 300)], "v int").repartition(7)
    got = rows(numbered(df, "v", name="at"), "at", "v")
    assert got == [(i + 1, v) for i, v in enumerate(sorted(v for _, v in got))] or sorted(got) == [(i + 1, v) for i, v in enumerate(sorted(v for _, v in got))]


def brute_ngrams(seqs, n):
    occ, rec = {}, {}
    for s in seqs:
        seen = set()
        for i in range(len(s)):
            for k in range(1, n + 1):
                if i + k <= len(s):
                    g = tuple(s[i : i + k])
                    occ[g] = occ.get(g, 0) + 1
                    seen.add(g)
        for g in seen:
            rec[g] = rec.get(g, 0) + 1
    return sorted(((list(g), occ[g], rec[g]) for g in occ), key=repr)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_ngrams(spark, n):
    rng = random.Random(n)
    seqs = [[rng.choice("abca") for _ in range(rng.randrange(1, 9))] for _ in range(200)]
    df = spark.createDataFrame([("f", s) for s in seqs], "field_name string, terms array<string>")
    assert rows(terms.ngram_counts(df, n), "gram", "occurrences", "records") == brute_ngrams(seqs, n)


@pytest.mark.parametrize("n", [1, 3])
def test_long_records_are_sorted(spark, n):
    """What begins before is found by sorting in long records and by comparing in short ones: the same."""
    rng = random.Random(7)
    seqs = [[rng.choice("abcaa") for _ in range(rng.randrange(1, 40))] for _ in range(60)] + [["x"] * 3000]
    df = spark.createDataFrame([("f", s) for s in seqs], "field_name string, terms array<string>")
    by = lambda short: rows(terms.suffixes(df.where(F.size("terms") < 100), n, short), "suffix", "old", "c")
    assert by(0) == by(10**6)
    assert rows(terms.ngram_counts(df, n), "gram", "occurrences", "records") == brute_ngrams(seqs, n)


def test_terms_and_marks(spark):
    v = "^bnk:a / (bnk:b)*|<http://cln.example.org/ns#c>"
    data = [(1, v), (1, v), (2, "bnk:a bnk:a"), (3, None), (4, ""), (5, " bnk:A;bnk:a"), (6, "http://x.org/y"), (None, "bnk:z"), (2, "bnk:d")]
    df = spark.createDataFrame(data, "result_id bigint, path string")
    seqs = terms.sequences(df, "result_id", {"f": "path"})
    got = rows(terms.marked(seqs, rare=1, common=0.5), "term", "occurrences", "records", "mark")
    assert got == sorted([("bnk:a", 4, 3, "common"), ("bnk:b", 1, 1, "rare"), ("cln:c", 1, 1, "rare"), ("bnk:A", 1, 1, "rare"), ("bnk:d", 1, 1, "rare")], key=repr)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(max_size=20), max_size=8))
def test_statements_never_fail(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] or [(0, None)], "response_id bigint, turtle string")
    assert badrows.read_turtle(df).count() == max(1, len(texts))


def test_records_that_cannot_be_parsed_are_listed(spark, tmp_path):
    from graphloom.queries_data import QUERIES

    deep = '{"iteration_log": ' + "[" * 100_000 + "]" * 100_000 + "}"
    data = [(1, '{"run": "a"}'), (2, "{broken"), (3, deep), (4, None)]
    spark.createDataFrame(data, "log_id bigint, payload string").write.parquet(str(tmp_path / "run_logs.parquet"))
    got = dict(rows(QUERIES["p1_errors"](spark, str(tmp_path))))
    assert set(got) == {2, 3} and "recursion" in got[3]
