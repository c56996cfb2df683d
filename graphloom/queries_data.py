"""Queries of the general data problems (1, 4, 5, 6, 7) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.common import keep, table
from graphloom.operators import badrows, copies, drift, nested, terms

Query = Callable[[SparkSession, str], DataFrame]


def _run_table(name: str) -> Query:
    return lambda s, d: nested.run_tables(table(s, d, "run_logs"))[name]


def _p7(s: SparkSession, d: str) -> DataFrame:
    return terms.marked(terms.field_terms(table(s, d, "patches"), table(s, d, "validation_results")))


def _p6_kept(s: SparkSession, d: str) -> DataFrame:
    """Of each line the values that the stable table holds, in a column or in ``rest``: all that the line has."""
    t = drift.consistent(table(s, d, "iteration_log_lines"))
    held = [F.when(F.col(f"`{c}`").isNotNull(), 1).otherwise(0) for c in t.columns if c not in (*drift.KEYS, "line_no", "rest", "raw")]
    return t.select("file_id", "line_no", (sum(held, F.lit(0)) + F.greatest(F.size("rest"), F.lit(0))).cast("bigint").alias("n"))


QUERIES: dict[str, Query] = {
    "p1_found": lambda s, d: nested.children(nested.shred_runs(table(s, d, "run_logs"))),
    "p1_errors": lambda s, d: nested.errors(nested.shred_runs(table(s, d, "run_logs"))),
    "p1_runs": _run_table("runs"),
    "p1_iterations": _run_table("iterations"),
    "p1_cq_results": _run_table("cq_results"),
    "p1_violations": _run_table("violations"),
    "p1_patch_types": _run_table("patch_types"),
    "p4_found": lambda s, d: badrows.found(table(s, d, "requirement_lines"), table(s, d, "llm_responses")),
    "p4_loaded": lambda s, d: badrows.read_lines(table(s, d, "requirement_lines")).where("reason is null").select("row_id", *badrows.COLUMNS),
    "p5_found": lambda s, d: copies.found(table(s, d, "requirement_records")),
    "p5_collapsed": lambda s, d: copies.collapsed(table(s, d, "requirement_records")),
    "p6_found": lambda s, d: drift.changes(table(s, d, "iteration_log_lines")),
    "p6_table": lambda s, d: drift.consistent(table(s, d, "iteration_log_lines")),
    "p6_kept": _p6_kept,
    "p6_lifespans": lambda s, d: drift.lifespans(keep(drift.catalogue(table(s, d, "iteration_log_lines")), "fields")),
    "p7_found": lambda s, d: _p7(s, d).where("mark is not null").select("field_name", "term", "mark"),
    "p7_counts": lambda s, d: _p7(s, d).select("field_name", "term", "occurrences", "records"),
    "p7_ngrams": lambda s, d: terms.ngram_counts(terms.sequences(table(s, d, "validation_results"), "result_id", {"validation_results.path": "path"}), 3).selectExpr("concat_ws(' ', gram) as gram", "occurrences", "records"),
}

_ITS = """
WITH logs AS (SELECT log_id, json(payload) AS j FROM run_logs WHERE payload IS NOT NULL),
il AS (SELECT log_id, CASE json_type(j, '$.iteration_log') WHEN 'ARRAY' THEN json_extract(j, '$.iteration_log[*]')
         WHEN 'OBJECT' THEN [json_extract(j, '$.iteration_log')] ELSE [] END AS a FROM logs),
its AS (SELECT log_id, CAST(i AS BIGINT) AS iter_pos, a[i + 1] AS it FROM il, unnest(range(len(a))) AS r(i) WHERE json_type(a[i + 1]) = 'OBJECT'),
rs AS (SELECT log_id, iter_pos, CASE json_type(it, '$.cq.results') WHEN 'ARRAY' THEN json_extract(it, '$.cq.results[*]')
         WHEN 'OBJECT' THEN [json_extract(it, '$.cq.results')] ELSE [] END AS a FROM its),
cq AS (SELECT log_id, iter_pos, CAST(i AS BIGINT) AS cq_pos, a[i + 1] AS c FROM rs, unnest(range(len(a))) AS r(i) WHERE json_type(a[i + 1]) = 'OBJECT'),
vi AS (SELECT log_id, iter_pos, k AS name, json_extract(it, '$.shacl.violations."' || k || '"') AS v FROM its, unnest(json_keys(it, '$.shacl.violations')) AS r(k) WHERE json_type(it, '$.shacl.violations') = 'OBJECT'),
pt AS (SELECT log_id, iter_pos, k AS name, json_extract(it, '$.patches.types."' || k || '"') AS v FROM its, unnest(json_keys(it, '$.patches.types')) AS r(k) WHERE json_type(it, '$.patches.types') = 'OBJECT')
"""

_PIECES = """
WITH l AS (SELECT line_id, raw_line AS raw, contains(raw_line, '"') AS q,
  regexp_full_match(raw_line, '(?s)(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*') AS sound FROM requirement_lines),
p AS (SELECT *, CASE WHEN NOT q THEN string_split(raw, ',') WHEN sound THEN regexp_extract_all(raw || ',', '(?s)("(?:[^"]|"")*"|[^",]*),', 1) END AS f FROM l),
u AS (SELECT *, [CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END FOR x IN f] AS v FROM p),
r AS (SELECT *, CASE WHEN raw IS NULL THEN 'column_count' WHEN f IS NULL THEN 'quoting' WHEN len(f) <> 6 THEN 'column_count'
  WHEN NOT (regexp_full_match(v[1], '[0-9]+') AND regexp_matches(v[3], '[^\\s\\p{Z}]') AND v[4] IN ('train', 'dev', 'test', '')
    AND regexp_full_match(v[5], '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_cast(v[5] AS DATE) IS NOT NULL AND regexp_full_match(v[6], '[1-5]')) THEN 'invalid_value' END AS reason FROM u)
"""

_KEYS = """
WITH r AS (SELECT rec_id, md5(concat_ws(chr(1),
    regexp_replace(lower(coalesce(json_extract_string(payload, '$.title'), '')), '[^\\p{L}\\p{N}]+', '', 'g'),
    regexp_replace(lower(coalesce(json_extract_string(payload, '$.text'), '')), '[^\\p{L}\\p{N}]+', '', 'g'))) AS k
  FROM requirement_records WHERE payload IS NOT NULL AND json_valid(payload)),
g AS (SELECT k, min(rec_id) AS keep_id, count(*) AS copies FROM r GROUP BY k HAVING count(*) > 1)
"""

_TERMS = """
WITH src AS (
  SELECT DISTINCT 'patches.source_shape' AS field_name, patch_id AS id, source_shape AS t FROM patches
  UNION ALL SELECT DISTINCT 'validation_results.constraint_component', result_id, constraint_component FROM validation_results
  UNION ALL SELECT DISTINCT 'validation_results.path', result_id, path FROM validation_results),
occ AS (SELECT field_name, id, unnest(regexp_extract_all(regexp_replace(t, '<http://([A-Za-z_][A-Za-z0-9_\\-]*)\\.example\\.org/ns#([^>\\s]+)>', ' \\1:\\2 ', 'g'),
  '[A-Za-z_][A-Za-z0-9_.\\-]*:[\\p{L}\\p{N}_](?:[\\p{L}\\p{N}_.\\-]*[\\p{L}\\p{N}_\\-])?')) AS term FROM src WHERE t IS NOT NULL AND id IS NOT NULL),
tot AS (SELECT field_name, count(DISTINCT id) AS total FROM occ GROUP BY 1),
cnt AS (SELECT field_name, term, count(*) AS occurrences, count(DISTINCT id) AS records FROM occ GROUP BY 1, 2),
m AS (SELECT cnt.*, CASE WHEN records <= 2 THEN 'rare' WHEN records > 0.05 * total THEN 'common' END AS mark FROM cnt JOIN tot USING (field_name))
"""

_TERM = r"""(?:"[^"\\]*(?:\\.[^"\\]*)*"(?:\^\^(?:<[^<>"\s]*>|[^\s"<>]+)|@[A-Za-z]+(?:-[A-Za-z0-9]+)*)?|<[^<>"\s]*>|[^\s"<][^\s"]*)"""
_TYPED = r"""(?:^|\s)"([^"\\]*(?:\\.[^"\\]*)*)"\^\^(?:xsd:|<http://www\.w3\.org/2001/XMLSchema#)(decimal|integer|boolean|dateTime)>?"""
_DT = r"-?(?:[1-9][0-9]{3,}|0[0-9]{3})-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])T(?:(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]+)?|24:00:00(?:\.0+)?)(?:Z|[+-](?:(?:0[0-9]|1[0-3]):[0-5][0-9]|14:00))?"
_TURTLE = rf"""
, t AS (SELECT response_id, list_filter(list_transform(string_split_regex(turtle, '\r\n|\n|\r'), lambda x: trim(x, E' \t\n\r')), lambda x: x <> '' AND NOT starts_with(x, '#') AND NOT starts_with(x, '@prefix') AND NOT starts_with(x, '```')) AS st FROM llm_responses),
s AS (SELECT response_id, unnest(st) AS x FROM t),
v AS (SELECT response_id, trim(unnest(regexp_extract_all(x, '{_TYPED}', 1)), E' \t\n\r') AS v, unnest(regexp_extract_all(x, '{_TYPED}', 2)) AS k FROM s),
bad AS (SELECT DISTINCT response_id FROM v WHERE NOT CASE k WHEN 'decimal' THEN regexp_full_match(v, '[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)') WHEN 'integer' THEN regexp_full_match(v, '[+-]?[0-9]+')
  WHEN 'boolean' THEN v IN ('true', 'false', '1', '0') ELSE regexp_full_match(v, '{_DT}') AND try_cast(substr(v, 1, 10) AS DATE) IS NOT NULL END),
q AS (SELECT response_id, bool_or(NOT regexp_full_match(x, '{_TERM}(?:\s+{_TERM})*')) AS quoting, bool_or(NOT regexp_full_match(x, '{_TERM}\s+{_TERM}\s+{_TERM}\s+\.')) AS cols FROM s GROUP BY 1),
w AS (SELECT q.response_id, CASE WHEN quoting THEN 'quoting' WHEN cols THEN 'column_count' WHEN bad.response_id IS NOT NULL THEN 'invalid_value' END AS reason FROM q LEFT JOIN bad ON bad.response_id = q.response_id)
"""
_DRIFT = r"""
WITH f AS (SELECT DISTINCT series_id, file_id, min(file_written_at) OVER (PARTITION BY file_id) AS written FROM iteration_log_lines),
o AS (SELECT *, lag(file_id) OVER (PARTITION BY series_id ORDER BY written, file_id) AS prev FROM f),
n AS (SELECT file_id, substr(j.fullkey, 3) AS path, CASE j.type WHEN 'ARRAY' THEN 'list' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'number' END AS t, count(*) AS c
  FROM (SELECT * FROM iteration_log_lines WHERE json_valid(payload)) l, json_tree(l.payload) j WHERE j.type NOT IN ('OBJECT', 'NULL') AND NOT contains(j.fullkey, '[') GROUP BY 1, 2, 3),
k AS (SELECT file_id, path, t FROM (SELECT *, row_number() OVER (PARTITION BY file_id, path ORDER BY c DESC, t) AS rn FROM n) WHERE rn = 1),
c AS (SELECT o.file_id, k.path, k.t AS nt, NULL AS ot FROM o JOIN k ON k.file_id = o.file_id WHERE prev IS NOT NULL UNION ALL SELECT o.file_id, k.path, NULL, k.t FROM o JOIN k ON k.file_id = o.prev),
d AS (SELECT file_id, path, max(nt) AS nt, max(ot) AS ot, regexp_replace(path, '\.?[^.]*$', '') AS parent FROM c GROUP BY 1, 2 HAVING max(nt) IS DISTINCT FROM max(ot)),
p AS (SELECT file_id, parent, count(nt) AS n_in, count(ot) AS n_out, max(nt) AS nt, max(ot) AS ot, max(CASE WHEN nt IS NOT NULL THEN path END) AS np, max(CASE WHEN ot IS NOT NULL THEN path END) AS op FROM d WHERE nt IS NULL OR ot IS NULL GROUP BY 1, 2),
r AS (SELECT * FROM p WHERE n_in = 1 AND n_out = 1 AND nt = ot)
SELECT file_id, 'type_changed' AS change_kind, path AS field_path, '' AS new_path FROM d WHERE nt IS NOT NULL AND ot IS NOT NULL
UNION ALL SELECT file_id, 'renamed', op, np FROM r
UNION ALL SELECT d.file_id, CASE WHEN d.nt IS NOT NULL THEN 'added' ELSE 'removed' END, d.path, '' FROM d LEFT JOIN r ON r.file_id = d.file_id AND r.parent = d.parent WHERE (d.nt IS NULL OR d.ot IS NULL) AND r.file_id IS NULL
"""
_KEPT = r"""
WITH l AS (SELECT file_id, line_no, payload FROM iteration_log_lines),
n AS (SELECT file_id, line_no, count(*) AS n FROM (SELECT * FROM l WHERE json_valid(payload)) l, json_tree(l.payload) j WHERE j.type NOT IN ('OBJECT', 'NULL') AND NOT contains(j.fullkey, '[') GROUP BY 1, 2)
SELECT l.file_id, l.line_no, coalesce(n, 0) AS n FROM l LEFT JOIN n USING (file_id, line_no)
"""
# Islands: the files of a series are numbered, and a field's unbroken runs share the difference of their numbers.
_SPANS = _DRIFT[: _DRIFT.index("c AS (")].replace("o AS (SELECT *,", "o AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY written, file_id) AS pos,").rstrip().rstrip(",") + r"""
, g AS (SELECT o.series_id, k.path, k.t, o.file_id, pos, pos - row_number() OVER (PARTITION BY o.series_id, k.path, k.t ORDER BY pos) AS island FROM k JOIN o ON o.file_id = k.file_id)
SELECT series_id, path AS field_path, t AS field_type, arg_min(file_id, pos) AS start_file, arg_max(file_id, pos) AS end_file FROM g GROUP BY series_id, path, t, island
"""
_NGRAMS = r"""
WITH src AS (SELECT result_id, list_sort(list(DISTINCT path)) AS ps FROM validation_results WHERE path IS NOT NULL AND result_id IS NOT NULL GROUP BY 1),
s AS (SELECT result_id, flatten(list_transform(ps, lambda x: regexp_extract_all(regexp_replace(x, '<http://([A-Za-z_][A-Za-z0-9_\-]*)\.example\.org/ns#([^>\s]+)>', ' \1:\2 ', 'g'), '[A-Za-z_][A-Za-z0-9_.\-]*:[\p{L}\p{N}_](?:[\p{L}\p{N}_.\-]*[\p{L}\p{N}_\-])?'))) AS t FROM src),
g AS (SELECT result_id, array_to_string(t[i + 1:i + k], ' ') AS gram FROM s, unnest(range(len(t))) AS a(i), (VALUES (1), (2), (3)) AS b(k) WHERE i + k <= len(t))
SELECT gram, count(*) AS occurrences, count(DISTINCT result_id) AS records FROM g GROUP BY 1
"""

SQL: dict[str, str] = {
    "p1_found": _ITS + """
SELECT log_id, iter_pos, 'cq_result' AS child, CAST(cq_pos AS VARCHAR) AS child_key FROM cq
UNION ALL SELECT log_id, iter_pos, 'violation', name FROM vi WHERE json_type(v) <> 'NULL'
UNION ALL SELECT log_id, iter_pos, 'patch_type', name FROM pt WHERE json_type(v) <> 'NULL'""",
    "p1_cq_results": _ITS + "SELECT log_id, iter_pos, cq_pos, c->>'$.query' AS query, try_cast(c->>'$.success' AS BOOLEAN) AS success, c->>'$.message' AS message FROM cq",
    "p1_violations": _ITS + "SELECT log_id, iter_pos, name, try_cast(v->>'$' AS BIGINT) AS n FROM vi WHERE json_type(v) <> 'NULL'",
    "p1_patch_types": _ITS + "SELECT log_id, iter_pos, name, try_cast(v->>'$' AS BIGINT) AS n FROM pt WHERE json_type(v) <> 'NULL'",
    "p1_runs": "SELECT log_id, payload->>'$.run' AS run, payload->>'$.config.policy' AS policy, try_cast(payload->>'$.config.thresholds.cq' AS DOUBLE) AS cq_threshold FROM run_logs WHERE payload IS NOT NULL",
    "p1_iterations": _ITS
    + "SELECT log_id, iter_pos, try_cast(it->>'$.iteration' AS BIGINT) AS iteration, try_cast(it->>'$.shacl.total' AS BIGINT) AS shacl_total, try_cast(it->>'$.cq.pass_rate' AS DOUBLE) AS cq_pass_rate, "
    + "try_cast(it->>'$.stop.decision' AS BOOLEAN) AS stop, it->>'$.stop.reason' AS stop_reason, it->>'$.reasoning.notes' AS notes FROM its",
    "p4_found": _PIECES + _TURTLE + "SELECT 'requirement_lines' AS row_source, line_id AS row_id, reason FROM r WHERE reason IS NOT NULL UNION ALL SELECT 'llm_responses', response_id, reason FROM w WHERE reason IS NOT NULL",
    "p6_found": _DRIFT,
    "p6_kept": _KEPT,
    "p6_lifespans": _SPANS,
    "p7_ngrams": _NGRAMS,
    "p4_loaded": _PIECES + "SELECT line_id AS row_id, v[1] AS req_no, v[2] AS title, v[3] AS text, v[4] AS split, CAST(v[5] AS DATE) AS created_on, CAST(v[6] AS INTEGER) AS priority FROM r WHERE reason IS NULL",
    "p5_found": _KEYS + "SELECT keep_id, rec_id AS dup_id FROM r JOIN g USING (k) WHERE rec_id > keep_id",
    "p5_collapsed": _KEYS + "SELECT keep_id, copies FROM g",
    "p7_found": _TERMS + "SELECT field_name, term, mark FROM m WHERE mark IS NOT NULL",
    "p7_counts": _TERMS + "SELECT field_name, term, occurrences, records FROM m",
}
