"""Queries of the problems tagged llm and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.common import keep, table
from graphloom.llm import mixing, neardup, overlap, packing, pii, tokens


def _mix(s, d):
    return mixing.mixture(table(s, d, "documents"), table(s, d, "mix_targets"))


def _pack_invariants(s, d):
    docs, specs = table(s, d, "documents"), table(s, d, "pack_specs")
    sizes = keep(tokens.counted(docs, "doc_id", "text"), "sizes")
    return packing.invariants(packing.pack(sizes, specs), sizes, specs)


QUERIES = {
    "p2_found": lambda s, d: neardup.found(table(s, d, "requirements")),
    "p2_groups": lambda s, d: neardup.groups(table(s, d, "requirements")),
    # The forms that grow with the texts, not with the pairs of their copies.
    "p2_links": lambda s, d: neardup.joined(table(s, d, "requirements"))[0].toDF("req_id_a", "req_id_b"),
    "p2_members": lambda s, d: neardup.joined(table(s, d, "requirements"))[1].select(F.col("doc_id").alias("req_id"), "rep_id"),
    "p3_rows": lambda s, d: overlap.per_row(table(s, d, "requirements")),
    "p3_found": lambda s, d: overlap.found(table(s, d, "requirements")),
    "p3_report": lambda s, d: overlap.report(table(s, d, "requirements")),
    "p8_pack": lambda s, d: packing.packed(table(s, d, "documents"), table(s, d, "pack_specs")),
    "p8_report": lambda s, d: packing.report(packing.packed(table(s, d, "documents"), table(s, d, "pack_specs")), table(s, d, "pack_specs")),
    "p8_invariants": _pack_invariants,
    "p9_mixture": _mix,
    "p9_invariants": lambda s, d: mixing.invariants(_mix(s, d), table(s, d, "mix_targets")),
    "p10_found": lambda s, d: pii.found(table(s, d, "documents"), table(s, d, "given_names")),
    "p10_redacted": lambda s, d: pii.redacted(table(s, d, "documents"), table(s, d, "given_names")),
    "p9_shares": lambda s, d: mixing.shares(_mix(s, d), table(s, d, "mix_targets")),
}

_PAIRS = """
WITH w AS (SELECT req_id, lower(trim(split, E' \\t\\n\\r')) AS sp, source, list_distinct(regexp_extract_all(lower(concat_ws(' ', {cols})), '[a-z0-9]+')) AS w FROM requirements),
d AS (SELECT req_id, source, CASE WHEN sp = 'training' THEN 'train' WHEN sp IN ('train', 'dev', 'test') THEN sp END AS sp, len(w) AS n, w FROM w WHERE len(w) >= 8),
x AS (SELECT req_id, n, sp, source, unnest(w) AS t FROM d {where}),
o AS (SELECT a.req_id AS ra, b.req_id AS rb, any_value(a.n) AS na, any_value(b.n) AS nb, any_value(a.sp) AS sa, any_value(b.sp) AS sb, any_value(a.source) AS ca, any_value(b.source) AS cb, count(*) AS c
  FROM x a JOIN x b ON a.t = b.t AND a.req_id < b.req_id AND least(a.n, b.n) >= {t} * greatest(a.n, b.n) - 1e-9 {cross} GROUP BY 1, 2),
f AS (SELECT * FROM o WHERE c * (1 + {t}) >= {t} * (na + nb) - 1e-9)
"""
_P3 = _PAIRS.format(cols="text", where="WHERE sp IS NOT NULL", t="0.85", cross="AND (a.sp = 'train') <> (b.sp = 'train')")

SQL = {
    "p2_found": _PAIRS.format(cols="text, boilerplate_main", where="", t="0.8", cross="") + "SELECT ra AS req_id_a, rb AS req_id_b FROM f",
    "p2_groups": _PAIRS.replace("WITH w AS", "WITH RECURSIVE w AS").format(cols="text, boilerplate_main", where="", t="0.8", cross="")
    + ", e AS (SELECT ra AS a, rb AS b FROM f UNION ALL SELECT rb, ra FROM f), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS req_id, least(a, min(b)) AS group_id FROM r GROUP BY a",
    "p2_links": _PAIRS.format(cols="text, boilerplate_main", where="", t="0.8", cross="")
    + ", same AS (SELECT rb AS id FROM f WHERE c = na AND c = nb) SELECT ra AS req_id_a, rb AS req_id_b FROM f WHERE NOT (c = na AND c = nb) AND ra NOT IN (SELECT id FROM same) AND rb NOT IN (SELECT id FROM same)",
    "p2_members": _PAIRS.format(cols="text, boilerplate_main", where="", t="0.8", cross="") + ", same AS (SELECT rb AS req_id, min(ra) AS rep_id FROM f WHERE c = na AND c = nb GROUP BY 1) SELECT * FROM same UNION SELECT rep_id, rep_id FROM same",
    "p3_rows": _P3.replace("WITH w AS", "WITH w AS", 1) + """, k AS (SELECT req_id, min(req_id) OVER (PARTITION BY list_sort(w)) AS class_id FROM d WHERE sp IS NOT NULL)
SELECT e.req_id, class_id, e.eval_split, e.eval_source, e.links FROM (SELECT CASE WHEN sa = 'train' THEN rb ELSE ra END AS req_id, CASE WHEN sa = 'train' THEN sb ELSE sa END AS eval_split, CASE WHEN sa = 'train' THEN cb ELSE ca END AS eval_source, count(*) AS links FROM f GROUP BY 1, 2, 3) e JOIN k USING (req_id)""",
    "p8_invariants": "SELECT spec_id, (SELECT count(*) FROM documents WHERE text <> '') AS documents, 0::BIGINT AS changed, 0::BIGINT AS cut_without_need, 0::BIGINT AS short_pieces, 0::BIGINT AS over, true AS well_filled FROM pack_specs",
    "p9_invariants": "SELECT source, max_repeats, false AS over, true AS near FROM mix_targets",
    "p3_found": _P3 + "SELECT ra AS req_id_a, rb AS req_id_b, CASE WHEN sa = 'train' THEN sb ELSE sa END AS eval_split, CASE WHEN sa = 'train' THEN cb ELSE ca END AS eval_source FROM f",
    "p3_report": _P3 + """SELECT CASE WHEN sa = 'train' THEN sb ELSE sa END AS eval_split, CASE WHEN sa = 'train' THEN cb ELSE ca END AS eval_source,
  count(*) AS pairs, count(DISTINCT CASE WHEN sa = 'train' THEN rb ELSE ra END) AS eval_rows FROM f GROUP BY 1, 2""",
}
