"""The same or nearly the same records across splits (problem 3): a weighted cosine join.

Terms are ordered from rare to common by their counts over all rows. A row's inverted-list
entries are its first terms, up to the point where the norm of the rest (the residual) is
below the threshold: a pair that shares none of them cannot reach it. A list too long for one
task is joined in the cells of a grid, cut on both sides. Where two entries meet,
the pair survives only if product plus residual norms reach the threshold, and if the largest
weights times the bounded overlap do. Survivors get the exact dot product.

With unit weights a Jaccard likeness t needs a cosine of 2 t / (1 + t); p3 joins at that
cosine and checks the likeness exactly.

Defined results: rows of no split (null or empty names), with a null or empty text or fewer
than 8 distinct words never count; a pair within one split is no overlap; classes of
identical word sets join through their representative, so none is expanded but in the result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.common import keep, pick
from graphloom.llm import words as W

#: Terms that get their own count in the order; there are never more that hold 1/50,000 of all occurrences.
COUNTED = 50_000
#: Entries of an inverted list that are joined at once; a longer list is joined in the cells of a grid.
MOST = 200_000
#: Entries of either side in a line of cells.
CELL = 20_000
ROW = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("side", pa.int8()), ("hot", pa.bool_()), ("n", pa.int32()), ("code", pa.int64()), ("w", pa.float32()), ("r", pa.float32()), ("mx", pa.float32())])


def split_of(c: Column) -> Column:
    s = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(s.isin("train", "training"), "train").when(s.isin("dev", "test"), s)


def common_terms(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes (sorted) and counts of the terms that hold at least 1/COUNTED of all occurrences, and the number of rows."""

    def run(batches):
        for b in batches:
            _, h, _, n, _ = W.large_enough(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist())
            t, c = np.unique(h.view(np.int64), return_counts=True)  # combined before the shuffle
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(c), pa.array(np.where(np.arange(len(t)) == 0, len(n), 0))], names=["t", "c", "rows"])

    part = docs.select("doc_id", "txt").mapInArrow(run, "t bigint, c bigint, rows bigint")
    sums = keep(part.groupBy("t").agg(F.sum("c").alias("c"), F.sum("rows").alias("rows")), "terms")
    total, rows = sums.agg(F.sum("c"), F.sum("rows")).first()
    least = max(2, math.ceil((total or 0) / COUNTED))
    top = sums.where(F.col("c") >= least).orderBy(F.desc("c"), "t").limit(COUNTED).toPandas().sort_values("t")
    return top.t.to_numpy(np.int64), top.c.to_numpy(np.int64), rows or 0


ENTRY = "key bigint, id bigint, side tinyint, hot boolean, n int, code bigint, w float, r float, mx float"
COLS = ("key", "id", "side", "n", "code", "w", "r", "mx")


#: The key of the entry that says that there are entries of counted terms in too many rows.
MARK = -(1 << 63)


def entries(docs: DataFrame, theta: float, terms: np.ndarray, counts: np.ndarray, rows: int, weighting: str = "unit", most: int = MOST, long: bool = False) -> DataFrame:
    """Inverted-list entries (key, id, side, hot, n, code, w, r, mx) of rows (doc_id, txt, role).

    side 0 is training, 2 evaluation, 1 both. hot: the term is counted in more than ``most`` rows;
    such entries come only if ``long``, else one entry a batch, under MARK, says that there are some.
    """

    def run(batches):
        for b in batches:
            ids, h, owner, n, (role,) = W.large_enough(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist(), b.column(2).to_numpy(zero_copy_only=False))
            if not len(ids):
                continue
            h = h.view(np.int64)
            count = np.ones(len(h), dtype=np.int64)
            if len(terms):
                at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
                count = np.where(terms[at] == h, counts[at], 1)
            w = np.ones(len(h)) if weighting == "unit" else np.log1p(rows / count)
            norm = np.sqrt(np.bincount(owner, w * w, minlength=len(ids)))
            w = w / norm[owner]
            order = np.lexsort((h, count, owner))
            hs, ws, os, cs = h[order], w[order], owner[order], count[order]
            sq = np.cumsum(ws * ws)
            ends = np.cumsum(n) - 1
            rest = np.maximum(sq[ends][os] - sq, 0)  # squared norm after this term
            sel = rest + ws * ws >= theta * theta - 1e-9  # before it the residual could still reach theta
            key = np.where(sel & (cs > most) & (not long), MARK, hs)
            if not long:
                marked = np.flatnonzero(key == MARK)
                sel[marked[1:]] = False
            mx = np.zeros(len(ids))
            np.maximum.at(mx, owner, w)
            code = W.count_codes(h.view(np.uint64), owner, len(ids))
            o = os[sel]
            side = np.array([-1, 0, 2, 1])[role[o]]
            yield pa.RecordBatch.from_arrays([
                pa.array(key[sel]), pa.array(ids[o]), pa.array(side.astype(np.int8)), pa.array(cs[sel] > most), pa.array(n[o].astype(np.int32)), pa.array(code[o]),
                pa.array(ws[sel].astype(np.float32)), pa.array(np.sqrt(rest[sel]).astype(np.float32)), pa.array(mx[o].astype(np.float32)),
            ], schema=ROW)

    return docs.select("doc_id", "txt", "role").mapInArrow(run, ENTRY)


def _met(theta: float, t: float | None, bound: int | None):
    """Pairs of a list's training and evaluation entries that may reach theta (and the likeness t); a list of
    more than ``bound`` entries gives its key instead, as (key, null)."""
    slack = theta - 1e-5  # the weights are single precision

    def run(batches):
        for x in W.bounded_blocks(batches, COLS, bound):
            told = x["key"] == MARK
            if told.any() and "hot" not in x:
                yield pa.RecordBatch.from_arrays([pa.array([MARK], pa.int64()), pa.nulls(1, pa.int64())], names=["id_a", "id_b"])
                x = {k: v[~told] for k, v in x.items()}
                if not len(x["key"]):
                    continue
            if "hot" in x:
                keys = np.unique(x["key"])
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.nulls(len(keys), pa.int64())], names=["id_a", "id_b"])
                continue
            x = W.prepared(x)
            start, _ = W.runs(x["key"])
            rows = np.arange(len(start))
            # Entries are sorted by side: those for training (0, 1) come first in a list.
            n_train = np.bincount(start, x["side"] < 2, minlength=len(start)).astype(np.int64)[start]
            for i, j in W.ranges(rows[x["side"] > 0], start[x["side"] > 0], (start + n_train)[x["side"] > 0]):
                ok = x["w"][i] * x["w"][j] + x["r"][i] * x["r"][j] >= slack  # residual norms
                i, j = i[ok], j[ok]
                o = np.minimum(W.most_overlap(x, i, j), np.minimum(x["n"][i], x["n"][j]))
                ok = (o * x["mx"][i] * x["mx"][j] >= slack) & (x["id"][i] != x["id"][j])  # largest weights
                if t is not None:
                    ok &= W.may_reach(x, i, j, t)
                if ok.any():
                    yield W.pair_batch(x["id"][j[ok]], x["id"][i[ok]])

    return run


def celled(inv: DataFrame, cell: int = CELL) -> DataFrame:
    """Long lists as the cells of a grid: training entries stand in a row of cells, evaluation entries in a column.

    Either side is cut into parts of about ``cell`` entries, so that a cell is bounded however
    the list divides; an entry is written once for each part of the other side.
    """
    both = F.when(F.col("side") == 1, F.array(F.lit(0), F.lit(2)).cast("array<tinyint>")).otherwise(F.array("side"))
    sided = inv.withColumn("side", F.explode(both))
    size = keep(sided.groupBy("key").agg(*(F.greatest(F.lit(1), F.ceil(F.count_if(F.col("side") == v) / cell)).cast("bigint").alias(c) for c, v in (("tp", 0), ("ep", 2)))), "lists")
    train = F.col("side") == 0
    own = F.pmod(F.xxhash64(F.lit(5), "id"), F.when(train, F.col("tp")).otherwise(F.col("ep")))
    other = F.sequence(F.lit(0), F.when(train, F.col("ep")).otherwise(F.col("tp")) - 1)
    cells = F.transform(other, lambda q: F.when(train, F.xxhash64("key", own, q)).otherwise(F.xxhash64("key", q, own)))
    # The lists are few (each holds more than MOST entries), but their number grows: Catalyst chooses the join by its size.
    return sided.join(size, "key").withColumn("key", F.explode(cells)).select(*COLS)


def candidates(docs: DataFrame, theta: float, weighting: str = "unit", t: float | None = None, most: int = MOST, cell: int = CELL) -> DataFrame:
    """Pairs (id_a, id_b), a with the training bit (1) and b with an evaluation bit (2) of ``role``, that may reach theta.

    Lists of terms that are counted and too long go to the grid at once; a list that turns out too
    long while it is read (its term held too small a share of all to be counted) goes there afterwards.
    """
    terms, counts, rows = common_terms(docs)
    made = lambda long: entries(docs, theta, terms, counts, rows, weighting, most, long)
    met = lambda x, bound: x.select(*COLS).repartition("key").sortWithinPartitions("key", "side").mapInArrow(_met(theta, t, bound), W.PAIRS).distinct()
    first = met(made(False), most)
    if rows <= most:  # no list is longer than there are rows
        return first
    first = keep(first, "met")
    late = keep(first.where("id_b is null").select(F.col("id_a").alias("key"), F.lit(True).alias("late")), "late")
    n_late, out = late.count(), first.where("id_b is not null")
    if n_late:
        long = made(True).join(F.broadcast(late) if n_late <= W.SMALL else late, "key", "left").where("hot or late").drop("late")
        out = out.unionByName(met(celled(long, cell), None)).distinct()
    return out


def linked(requirements: DataFrame, t: float = 0.85) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, training rows, evaluation rows) of the overlaps with a likeness of at least t.

    links (id_a, id_b) are of class representatives, of a class with itself where its rows lie on both sides;
    training rows (id_a, train_id) and evaluation rows (id_b, eval_id, eval_split, eval_source) name theirs.
    """
    docs = W.texts(pick(requirements, "req_id", "text", "split", "source"), "req_id", ["text"], split_of(F.col("split")).alias("split"), F.col("source")).where("split is not null")
    members, copies, n = W.classes(docs, "split", "source")
    own = F.when(F.col("split") == "train", 1).otherwise(2)
    # A representative carries the splits of all its class; classes of several rows are no more than the copies, which are counted.
    bits = members.groupBy("rep_id").agg(F.bit_or(own).cast("tinyint").alias("bits")).withColumnRenamed("rep_id", "doc_id")
    reps = W.filtered(docs, copies, n, "doc_id", "left_anti")
    reps = reps.join(F.broadcast(bits) if n <= W.SMALL else bits, "doc_id", "left").select("doc_id", "txt", F.coalesce("bits", own.cast("tinyint")).alias("role"))
    pairs = keep(W.verified(candidates(reps, 2 * t / (1 + t) - 1e-9, t=t), docs, t), "overlaps")
    # Back to rows: a representative stands for its members; rows that are a class of their own for themselves.
    ids = keep(pairs.select(F.explode(F.array("id_a", "id_b")).alias("rep_id")).distinct(), "ids")
    alone = W.filtered(docs.select(F.col("doc_id").alias("rep_id"), "split", "source"), ids, ids.count(), "rep_id", "left_semi").select("rep_id", F.col("rep_id").alias("doc_id"), "split", "source")
    m = members.select("rep_id", "doc_id", "split", "source")
    rows = m.unionByName(alone.join(m.select("rep_id").distinct(), "rep_id", "left_anti"))
    itself = bits.where("bits = 3").select(F.col("doc_id").alias("id_a"), F.col("doc_id").alias("id_b"))
    train = rows.where("split = 'train'").select(F.col("rep_id").alias("id_a"), F.col("doc_id").alias("train_id"))
    held = rows.where("split <> 'train'").select(F.col("rep_id").alias("id_b"), F.col("doc_id").alias("eval_id"), F.col("split").alias("eval_split"), F.col("source").alias("eval_source"))
    return pairs.unionByName(itself), train, held


def overlaps(requirements: DataFrame, t: float = 0.85) -> DataFrame:
    """(train_id, eval_id, eval_split, eval_source) of every overlap with a likeness of at least t."""
    links, train, held = linked(requirements, t)
    return links.join(train, "id_a").join(held, "id_b").select("train_id", "eval_id", "eval_split", "eval_source")


def found(requirements: DataFrame, t: float = 0.85) -> DataFrame:
    """p3_found: (req_id_a, req_id_b, eval_split, eval_source), req_id_a < req_id_b."""
    return overlaps(requirements, t).select(F.least("train_id", "eval_id").alias("req_id_a"), F.greatest("train_id", "eval_id").alias("req_id_b"), "eval_split", "eval_source")


def per_row(requirements: DataFrame, t: float = 0.85) -> DataFrame:
    """(req_id, class_id, eval_split, eval_source, links): each evaluation row that overlaps, its class and its number of training rows. No pairs are written out."""
    links, train, held = linked(requirements, t)
    n = train.groupBy("id_a").agg(F.count("*").alias("n"))
    by = links.join(n, "id_a").groupBy("id_b").agg(F.sum("n").alias("links"))
    return held.join(by, "id_b").select(F.col("eval_id").alias("req_id"), F.col("id_b").alias("class_id"), "eval_split", "eval_source", "links")


def report(requirements: DataFrame, t: float = 0.85) -> DataFrame:
    """Overlapping pairs and evaluation rows per split and source."""
    return per_row(requirements, t).groupBy("eval_split", "eval_source").agg(F.sum("links").alias("pairs"), F.count("*").alias("eval_rows"))
