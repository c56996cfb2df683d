"""Schemas that drift between files (problem 6): a column lifespan catalogue.

The catalogue has a row per file, field and type, aggregated on the map side before any
shuffle. ``lag`` over the files of a series turns it into islands (lifespans); their starts
and endings are the log of changes. The catalogue, its renames and an alias table generate the
columns and casts of one stable table, in which every value stays.

Defined results: a null or unreadable payload has no fields, its file still counts; ties in
time go by file_id; of several types in one file the one on most lines holds, then the
first by name; an empty object is no field.
"""

from __future__ import annotations

import json
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructField, StructType

from graphloom.common import keep, numbered, pick, spread

#: Files whose lifespans are looked at together.
BLOCK = 1024
#: Fields that become columns of the stable table, those of most files first; values of further ones stand in ``rest``.
MOST = 1000
TYPES = {"boolean": "boolean", "number": "double", "list": "string", "string": "string"}
KEYS = ("series_id", "file_id", "file_written_at")


def kind_of(v) -> str:
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    return "list" if isinstance(v, list) else "string"


def leaves(doc: dict):
    """(dotted path, value) of each member that is neither an object nor null."""
    stack = [("", doc)]
    while stack:
        at, v = stack.pop()
        if isinstance(v, dict):
            stack.extend((f"{at}.{k}" if at else k, x) for k, x in v.items())
        elif v is not None and at:
            yield _sound(at), v


def _sound(text: str) -> str:
    """Without lone surrogates, which no column can hold."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode()


def _parse(text: str | None):
    try:
        doc = json.loads(text) if text else None
    except (ValueError, RecursionError):
        doc = None
    return doc if isinstance(doc, dict) else {}


def catalogue(lines: DataFrame) -> DataFrame:
    """(series_id, file_id, file_written_at, field_path, field_type, n); field_path null stands for the file itself."""
    schema = pa.schema([("series_id", pa.string()), ("file_id", pa.int64()), ("file_written_at", pa.timestamp("us")), ("field_path", pa.string()), ("field_type", pa.string()), ("n", pa.int64())])

    def run(batches):
        for b in batches:
            seen: Counter = Counter()
            s, f, w, p = (b.column(i).to_pylist() for i in range(4))
            for key in zip(s, f, w, p):
                seen[(*key[:3], None, None)] += 1
                for path, v in leaves(_parse(key[3])):
                    seen[(*key[:3], path, kind_of(v))] += 1
            rows = [(*k, n) for k, n in seen.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)] if rows else [pa.array([], t) for t in schema.types], schema=schema)

    src = pick(lines, *KEYS, "payload").select("series_id", F.col("file_id").cast("bigint"), F.col("file_written_at").cast("timestamp_ntz"), "payload")
    part = spread(src).mapInArrow(run, "series_id string, file_id bigint, file_written_at timestamp_ntz, field_path string, field_type string, n bigint")
    return part.groupBy("series_id", "file_id", "file_written_at", "field_path", "field_type").agg(F.sum("n").alias("n"))


def ordered_files(cat: DataFrame) -> DataFrame:
    """(series_id, file_id, pos, has_prev, next_file): all files numbered by series and time."""
    files = cat.where("field_path is null").groupBy("series_id", "file_id").agg(F.min("file_written_at").alias("file_written_at"))
    pos = keep(numbered(files, "series_id", "file_written_at", "file_id").select("series_id", "file_id", "pos"), "files")
    side = lambda by, c: pos.select((F.col("pos") + by).alias("pos"), F.col("series_id").alias(f"s{c}"), F.col("file_id").alias(c))
    near = pos.join(side(1, "prev"), "pos", "left").join(side(-1, "next"), "pos", "left")
    same = lambda c: F.col(f"s{c}").eqNullSafe(F.col("series_id")) & F.col(c).isNotNull()
    return near.select("series_id", "file_id", "pos", same("prev").alias("has_prev"), F.when(same("next"), F.col("next")).alias("next_file"))


def boundaries(cat: DataFrame) -> DataFrame:
    """(series_id, file_id, pos, field_path, field_type, has_prev, next_file, starts, ends) of the files in which a lifespan starts or ends.

    ``lag`` and ``lead`` run in blocks of ``BLOCK`` files, so that a series that fills the
    collection is no single task; a file at a block's edge stands in the next block too.
    """
    best = cat.where("field_path is not null").groupBy("file_id", "field_path", "field_type").agg(F.sum("n").alias("n"))
    one = best.groupBy("file_id", "field_path").agg(F.min(F.struct(-F.col("n"), "field_type")).alias("m")).select("file_id", "field_path", F.col("m.field_type").alias("field_type"))
    at = one.join(ordered_files(cat), "file_id")
    b, edge = F.floor(F.col("pos") / BLOCK), F.pmod("pos", F.lit(BLOCK))
    blocks = F.array(b, F.when(edge == 0, b - 1), F.when(edge == BLOCK - 1, b + 1))
    rows = at.withColumn("block", F.explode(F.filter(blocks, lambda x: x.isNotNull())))
    w = Window.partitionBy("block", "series_id", "field_path", "field_type").orderBy("pos")
    rows = rows.withColumns({"before": F.lag("pos").over(w), "after": F.lead("pos").over(w)}).where(F.col("block") == b)
    starts, ends = F.col("before").isNull() | (F.col("pos") - F.col("before") > 1), F.col("after").isNull() | (F.col("after") - F.col("pos") > 1)
    return rows.withColumns({"starts": starts, "ends": ends}).where("starts or ends").drop("block", "before", "after")


def lifespans(cat: DataFrame) -> DataFrame:
    """(series_id, field_path, field_type, start_file, end_file) of each unbroken run of files with a field and type."""
    edge = boundaries(cat)
    w = Window.partitionBy("series_id", "field_path", "field_type").orderBy("pos")  # only where something changes
    nth = lambda c: edge.where(c).withColumn("k", F.row_number().over(w))
    keys = ["series_id", "field_path", "field_type", "k"]
    return nth("starts").select(*keys, F.col("file_id").alias("start_file")).join(nth("ends").select(*keys, F.col("file_id").alias("end_file")), keys).drop("k")


def changes(lines: DataFrame) -> DataFrame:
    """p6_found: (file_id, change_kind, field_path, new_path) of each file against the one before it."""
    return changed(keep(catalogue(lines), "fields"))


def changed(cat: DataFrame) -> DataFrame:
    """``changes`` from the catalogue."""
    edge = keep(boundaries(cat), "boundaries")
    none = F.lit(None).cast("string")
    starts = edge.where("starts and has_prev").select("file_id", "field_path", F.col("field_type").alias("new_type"), none.alias("old_type"))
    ends = edge.where("ends and next_file is not null").select(F.col("next_file").alias("file_id"), "field_path", none.alias("new_type"), F.col("field_type").alias("old_type"))
    both = starts.unionByName(ends).groupBy("file_id", "field_path").agg(F.max("new_type").alias("new_type"), F.max("old_type").alias("old_type"))
    typed = both.where("new_type is not null and old_type is not null").select("file_id", F.lit("type_changed").alias("change_kind"), "field_path", F.lit("").alias("new_path"))
    moved = both.where("new_type is null or old_type is null").withColumn("parent", F.regexp_replace("field_path", r"\.?[^.]*$", ""))
    entered, left = F.col("new_type").isNotNull(), F.col("old_type").isNotNull()
    # A parent has as many fields as its schema: per file and parent the few fields that came or went.
    per = moved.groupBy("file_id", "parent").agg(
        F.count_if(entered).alias("n_in"), F.count_if(left).alias("n_out"), F.max("new_type").alias("nt"), F.max("old_type").alias("ot"),
        F.max(F.when(entered, F.col("field_path"))).alias("new_path"), F.max(F.when(left, F.col("field_path"))).alias("field_path"),
    )
    same = per.where("n_in = 1 and n_out = 1 and nt = ot").select("file_id", "parent", "new_path", "field_path")
    renamed = same.select("file_id", F.lit("renamed").alias("change_kind"), "field_path", "new_path")
    rest = moved.join(same.select("file_id", "parent"), ["file_id", "parent"], "left_anti").select("file_id", F.when(entered, "added").otherwise("removed").alias("change_kind"), "field_path", F.lit("").alias("new_path"))
    return typed.unionByName(renamed).unionByName(rest)


#: Stable column -> (type, spellings it is known to have had). Fixed values of this data's producers; ``columns`` adds to them.
ALIASES = {
    "iteration": ("bigint", ["iteration"]),
    "shacl_total": ("bigint", ["shacl.total"]),
    "hard": ("bigint", ["shacl.violations.hard", "shacl.violations.hardCount", "shacl.violations.violations_hard"]),
    "soft": ("bigint", ["shacl.violations.soft"]),
    "cq_pass_rate": ("double", ["cq.pass_rate", "cq.passRate", "cq.rate"]),
    "cq_failed": ("bigint", ["cq.failed", "cq.failedCount", "cq.n_failed"]),
    "patch_count": ("bigint", ["patches.count", "patches.patchCount", "patches.n_patches"]),
    "add_property": ("bigint", ["patches.types.addProperty", "patches.types.AddProperty", "patches.types.addProp", "patches.types.add_property", "patches.types.propertyAdded"]),
    "add_subclass": ("bigint", ["patches.types.addSubclass", "patches.types.add_subclass", "patches.types.subclassAdded"]),
    "notes": ("string", ["reasoning.notes", "reasoning.Notes", "reasoning.note", "reasoning.reasoner_notes"]),
    "stop": ("boolean", ["stop.decision"]),
    "stop_reason": ("string", ["stop.reason", "stop.why"]),
}


def columns(cat: DataFrame, log: DataFrame, aliases: dict[str, tuple[str, list[str]]] = ALIASES) -> dict[str, tuple[str, list[str]]]:
    """Stable column -> (type, spellings) for every field of the catalogue.

    The aliases given come first. Two fields that the log calls renamed share a column, unless
    spellings of both stand in one file: then one left and another came by chance. A column that
    is not given has the type most of its values have, and the name of its spelling in most files.
    """
    known = cat.where("field_path is not null")
    per = known.groupBy("field_path").agg(F.count_distinct("file_id").alias("files"), *(F.sum(F.when(F.col("field_type") == k, F.col("n")).otherwise(0)).alias(k) for k in TYPES))
    seen = {r.field_path: r for r in per.orderBy(F.desc("files"), "field_path").limit(MOST).collect()}
    groups = {c: list(ps) for c, (_, ps) in aliases.items()}
    of = {p: c for c, ps in groups.items() for p in ps}
    groups |= {("", p): [p] for p in seen if p not in of}
    of |= {p: ("", p) for p in seen if p not in of}

    paths = known.where(F.col("field_path").isin(list(of))).select("file_id", F.regexp_replace("field_path", r"\.?[^.]*$", "").alias("parent"), F.col("field_path").alias("a")).distinct()
    together = {(r.a, r.b) for r in paths.join(paths.withColumnRenamed("a", "b"), ["file_id", "parent"]).where("a <> b").select("a", "b").distinct().collect()}
    links = log.where(F.col("change_kind") == "renamed").groupBy("field_path", "new_path").agg(F.count("*").alias("n"))
    links = links.where(F.col("field_path").isin(list(of)) & F.col("new_path").isin(list(of))).collect()
    for a, b, _ in sorted(links, key=lambda r: (-r.n, r.field_path, r.new_path)):
        x, y = of[a], of[b]
        if y in aliases:
            x, y = y, x
        if x == y or y in aliases or any((p, q) in together for p in groups[x] for q in groups[y]):
            continue
        groups[x] += groups.pop(y)
        of |= {p: x for p in groups[x]}

    out = {c: (t, groups[c]) for c, (t, _) in aliases.items()}
    taken = {c.lower() for c in (*KEYS, "line_no", "rest", "raw", *aliases)}
    for c, ps in sorted((c, ps) for c, ps in groups.items() if c not in aliases):
        ps = sorted(ps, key=lambda p: (-seen[p].files, p))
        kind = max(TYPES, key=lambda k: (sum(seen[p][k] for p in ps), k))
        name = stem = re.sub(r"\W", "_", ps[0]).lower()
        i = 1
        while name.lower() in taken:
            i += 1
            name = f"{stem}_{i}"
        taken.add(name.lower())
        out[name] = (TYPES[kind], ps)
    return out


def values(lines: DataFrame) -> DataFrame:
    """The lines with ``fields``: a map of the text of every value by its field path; lists as JSON."""
    src = pick(lines, *KEYS, "line_no", "payload")
    text = lambda v: _sound(v if isinstance(v, str) else json.dumps(v, ensure_ascii=False))

    def run(batches):
        for b in batches:
            maps = [[(p, text(v)) for p, v in dict(leaves(_parse(t))).items()] for t in b.column("payload").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(maps, pa.map_(pa.string(), pa.string()))], names=[*b.schema.names, "fields"])

    return spread(src).mapInArrow(run, StructType([*src.schema.fields, StructField("fields", MapType(StringType(), StringType()))]))


def consistent(lines: DataFrame, aliases: dict[str, tuple[str, list[str]]] = ALIASES) -> DataFrame:
    """All files in one table with stable columns; names, types and spellings come from ``columns``.

    ``rest`` has the text of every value that is in no column, by field path: one that does not
    cast, a second spelling in one line, a field beyond ``MOST``. ``raw`` is the payload.
    """
    cat = keep(catalogue(lines), "fields")
    chains = columns(cat, changed(cat), aliases)
    one = lambda p, t: F.try_element_at("fields", F.lit(p)).try_cast(t)
    used = (F.coalesce(*(F.when(one(p, t).isNotNull(), F.lit(p)) for p in ps)) for t, ps in chains.values())
    left = F.array_except(F.map_keys("fields"), F.array_compact(F.array(*used)))
    rest = F.map_from_entries(F.transform(left, lambda k: F.struct(k, F.try_element_at("fields", k))))
    return values(lines).select(*KEYS, "line_no", *(F.coalesce(*(one(p, t) for p in ps)).alias(c) for c, (t, ps) in chains.items()), rest.alias("rest"), F.col("payload").alias("raw"))
