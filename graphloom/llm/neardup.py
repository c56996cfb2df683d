"""Near-duplicates with small edits (problem 2): an exact set join over token groups.

Tokens are hashed into groups; a row's counts by group are a point, and the overlap of two
rows is bounded by the summed minima of the coordinates before a pair is verified. One tree over
all points does not help: over tens of coordinates all its boxes overlap, and a search visits
nearly every leaf. So the groups are a directory first. Two rows of sizes up to u that reach the
likeness t differ in at most D = u (1 - t) / t tokens, so of D + 2 groups at least two hold the
same tokens on both sides; rows meet under the content of one group with two or more tokens, or
of two groups with fewer. Under each key the points are packed into the leaves of a tree: a
leaf's box is the maximum of its points by coordinate, and a row is compared with the points of a
leaf only where the summed minima of its own point and the box can reach the likeness.

A content that many rows share would be a poor key. Those of some ``BOUND`` rows or more are found in
a planning sample and are keys only together with a second group, like the groups of few tokens;
whichever contents are taken for common, two rows that agree on enough groups still meet. What the
sample missed shows when it is read: a key of more than ``LIMIT`` rows is not searched, its rows go on
to a round among themselves with D + 3 groups, of which three agree, and so on; a round is
complete for the rows that enter it. The last round searches every key, a large one in the
cells of a grid. So the work under a key is bounded and no pair is lost. Very long rows, whose
combinations of groups would be too many, take D + 1 groups and meet under each single one.

Defined results: rows with fewer than 8 distinct words (also null and empty texts) never
count; identical rows are a class, and only its representative enters the join; ids are
unique, a row without an id is left out.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.common import keep, pick
from graphloom.llm import words as W

U = np.uint64
NONE = np.zeros(0, np.int64)
#: Rows under a key from which on its content counts as common, and rows under a key that are searched at all before the last round.
BOUND, LIMIT = 256, 4096
#: Rounds, of growing depth; the last one searches all keys.
ROUNDS = 3
#: The planning sample: one row in SHARE, but no more than SAMPLE rows (then it finds less, and more is left to the rounds).
SHARE, SAMPLE, SEEN = 16, 1_000_000, 4
#: Points in a leaf, and rows in a line of cells of a large key.
LEAF, CELL = 8, 20_000
ROW = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("n", pa.int32()), ("small", pa.int8()), ("code", pa.int64())])


def size_bounds(t: float, top: int) -> np.ndarray:
    """Lower bounds of the size classes: partners are in one class or in neighbouring ones."""
    b = [W.LEAST_WORDS]
    while b[-1] <= top:
        b.append(math.floor(b[-1] / t + 1e-9) + 1)
    return np.array([*b, math.floor(b[-1] / t + 1e-9) + 1])


@functools.lru_cache(256)
def _combinations(w: int, k: int) -> np.ndarray:
    """All k of w places, a column each."""
    return np.array(list(itertools.combinations(range(w), k))).T


@functools.lru_cache(4096)
def depth_of(most: int, t: float, wanted: int) -> int:
    """The depth for the size class up to ``most`` words: the wanted one, or less where its combinations would outgrow the groups."""
    for d in range(wanted, 0, -1):
        m = math.floor(most * (1 - t) / t + 1e-9) + 1 + d
        rate = most / m
        weak = m * sum(math.exp(-rate) * rate**i / math.factorial(i) for i in range(d + 1))
        if math.prod(max(weak - i, 0) for i in range(d + 1)) / math.factorial(d + 1) <= 2 * m:
            return d
    return 0


def _listed(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which keys stand in the sorted array ``some``."""
    if not len(some):
        return np.zeros(len(keys), bool)
    k = keys.view(np.int64)
    return some[np.minimum(np.searchsorted(some, k), len(some) - 1)] == k


def group_keys(h: np.ndarray, owner: np.ndarray, groups: np.ndarray, tag: np.ndarray, depth: int, common: np.ndarray = NONE) -> tuple[np.ndarray, np.ndarray]:
    """(keys, row of each) for rows with ``groups`` token groups under the size class ``tag``.

    A group of many tokens is a key by itself, unless its content is one of the ``common`` ones;
    such a group, like one of few tokens, is a key together with ``depth`` others of these kinds.
    """
    first = np.concatenate([[0], np.cumsum(groups)])
    cell = first[owner] + (W.mix(h) % groups[owner].astype(U)).astype(np.int64)
    content = np.zeros(first[-1], dtype=U)
    np.add.at(content, cell, W.mix(h ^ U(0xA0761D6478BD642F)))
    count = np.bincount(cell, minlength=first[-1])
    row = np.repeat(np.arange(len(groups)), groups)
    place = np.arange(first[-1]) - first[row]
    key = W.mix(content + W.mix(place.astype(U) * U(1 << 20) + tag[row].astype(U)))
    strong = (count > depth) & ~_listed(key, common)
    keys, rows = [key[strong]], [row[strong]]
    weak, weak_row = key[~strong], row[~strong]
    per = np.bincount(weak_row, minlength=len(groups))
    start = np.cumsum(per) - per
    for w in np.unique(per[per > depth]):
        who = np.flatnonzero(per == w)
        mixed = U(0)
        for c in _combinations(int(w), depth + 1):
            mixed = W.mix(mixed * U(3) + weak[start[who][:, None] + c])
        keys.append(mixed.ravel())
        rows.append(np.repeat(who, mixed.shape[1]))
    return np.concatenate(keys), np.concatenate(rows)


def signatures(docs: DataFrame, t: float, depth: int, common: np.ndarray = NONE) -> DataFrame:
    """(key, id, n, small, code): the groups under which a row meets its partners.

    Each row stands in its own size class (small) and as the larger side in the class below.
    """

    def run(batches):
        for b in batches:
            ids, h, owner, n, _ = W.large_enough(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist())
            if not len(ids):
                continue
            code = W.count_codes(h, owner, len(ids))
            bounds = size_bounds(t, int(n.max()))
            own = np.searchsorted(bounds, n, "right") - 1
            for down in (0, 1):
                cls = own - down
                fits = cls >= 0
                most = np.where(fits, bounds[np.maximum(cls, 0) + 1] - 1, 0)
                depths = np.array([depth_of(int(x), t, depth) for x in most])
                for d in np.unique(depths[fits]):
                    mine = fits & (depths == d)
                    new = np.cumsum(mine) - 1
                    sel = mine[owner]
                    groups = np.floor(most[mine] * (1 - t) / t + 1e-9).astype(np.int64) + 1 + int(d)
                    keys, rows = group_keys(h[sel], new[owner[sel]], groups, cls[mine], int(d), common)
                    at = np.flatnonzero(mine)[rows]
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ids[at]), pa.array(n[at].astype(np.int32)), pa.array(np.full(len(at), 1 - down, dtype=np.int8)), pa.array(code[at])], schema=ROW)

    return docs.select("doc_id", "txt").mapInArrow(run, "key bigint, id bigint, n int, small tinyint, code bigint")


def leaves(x: dict) -> dict:
    """The packed points under each key: leaves of up to LEAF rows with the box of their points.

    Rows are sorted by key and then by size, so that a leaf's rows are alike in size.
    """
    start, _ = W.runs(x["key"])
    leaf = (np.arange(len(start)) - start) // LEAF
    at = np.flatnonzero(np.concatenate([[True], (start[1:] != start[:-1]) | (leaf[1:] != leaf[:-1])]))
    ends = np.concatenate([at[1:], [len(start)]])
    _, run_end = W.runs(start[at])  # leaves of one key
    return {
        "at": at, "end": ends, "of": np.repeat(np.arange(len(at)), ends - at), "last": run_end,
        "code": np.bitwise_or.reduceat(x["code"], at), "over": np.maximum.reduceat(x["over"], at), "least": np.minimum.reduceat(x["n"], at), "most": np.maximum.reduceat(x["n"], at),
    }


def box_may_reach(x: dict, box: dict, i: np.ndarray, k: np.ndarray, t: float) -> np.ndarray:
    """Some point within leaf k's box could reach likeness t with row i: by sizes, and by the summed minima."""
    n = x["n"][i]
    overlap = np.bitwise_count(x["code"][i] & box["code"][k]).astype(np.int64) + np.minimum(x["over"][i], box["over"][k])
    return (box["most"][k] >= t * n - 1e-9) & (n >= t * box["least"][k] - 1e-9) & (overlap * (1 + t) >= t * (n + box["least"][k]) - 1e-9)


def searched(x: dict, t: float):
    """(i, j), i < j, of all pairs under one key whose bounded overlap may reach t."""
    box = leaves(x)
    rows = np.arange(len(x["key"]))
    for i, k in W.ranges(rows, box["of"], box["last"][box["of"]]):
        ok = box_may_reach(x, box, i, k, t)
        i, k = i[ok], k[ok]
        for a, j in W.ranges(i, np.maximum(i + 1, box["at"][k]), box["end"][k]):
            ok = ((x["small"][a] | x["small"][j]) == 1) & (x["id"][a] != x["id"][j])
            a, j = a[ok], j[ok]
            ok = W.may_reach(x, a, j, t)
            if ok.any():
                yield a[ok], j[ok]


def _met(t: float, limit: int | None):
    """Pairs under one key that may reach t; a key of more than ``limit`` rows gives its ids instead, as (id, null)."""

    def run(batches):
        for x in W.bounded_blocks(batches, ("key", "id", "n", "small", "code"), limit):
            if "hot" in x:
                ids = np.unique(x["hot"])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.nulls(len(ids), pa.int64())], names=["id_a", "id_b"])
                continue
            x = W.prepared(x)
            for i, j in searched(x, t):
                a, b = x["id"][i], x["id"][j]
                yield W.pair_batch(np.minimum(a, b), np.maximum(a, b))

    return run


def planned(docs: DataFrame, n: int, t: float, depth: int, bound: int = BOUND, share: int = SHARE) -> np.ndarray:
    """Contents that seem to be shared by ``bound`` of ``n`` rows or more, by a sample; at most some 25 a row of SAMPLE / SEEN rows."""
    share = max(share, n // SAMPLE)
    some = docs.where(F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(share)) == 0)
    part = signatures(some, t, depth).groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") >= max(min(SEEN, bound), bound // share)).select("key")
    return np.sort(part.toPandas().key.to_numpy(np.int64))


def celled(sig: DataFrame, cell: int) -> DataFrame:
    """A key of more than ``cell`` rows becomes the cells of a grid: each row stands in a line of cells, and each pair meets in one."""
    large = keep(sig.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > cell).select("key", F.ceil(F.col("c") / cell).cast("bigint").alias("parts")), "large")
    if large.isEmpty():
        return sig
    own = F.pmod(F.xxhash64(F.lit(5), "id"), F.col("parts"))
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.xxhash64("key", F.least(own, q), F.greatest(own, q)))
    out = sig.join(large, "key", "left")
    return out.withColumn("key", F.explode(F.when(F.col("parts").isNull(), F.array("key")).otherwise(cells))).drop("parts")


def links(docs: DataFrame, t: float = 0.8, depth: int = 1, bound: int = BOUND, limit: int = LIMIT, rounds: int = ROUNDS, cell: int = CELL, share: int = SHARE) -> tuple[DataFrame, DataFrame]:
    """(links, members): pairs of class representatives with likeness t or more, and the members of classes with several rows."""
    members, copies, n = W.classes(docs)
    rows = W.filtered(docs, copies, n, "doc_id", "left_anti")
    left, found = docs.count(), []
    for k in range(rounds):
        last = k == rounds - 1
        sig = signatures(rows, t, depth + k, planned(rows, left, t, depth + k, bound, share))
        if last:
            sig = celled(sig, cell)
        met = keep(sig.repartition("key").sortWithinPartitions("key", "n").mapInArrow(_met(t, None if last else limit), W.PAIRS).distinct(), "met")
        found.append(met.where("id_b is not null"))
        left = 0 if last else met.where("id_b is null").count()
        if not left:
            break
        hot = keep(met.where("id_b is null").select(F.col("id_a").alias("doc_id")), "hot")
        rows = W.filtered(docs, hot, left, "doc_id", "left_semi")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return W.verified(out.distinct() if len(found) > 1 else out, docs, t), members


def expanded(found: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs of rows (id_a < id_b): links with every copy, and the copies of a class among themselves."""
    m = members.select("doc_id", "rep_id")
    side = lambda d, c: d.join(m.select(F.col("doc_id").alias("m"), F.col("rep_id").alias(c)), c, "left").withColumn(c, F.coalesce("m", c)).drop("m")
    across = side(side(found, "id_a"), "id_b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    within = m.alias("x").join(m.alias("y"), F.expr("x.rep_id = y.rep_id and x.doc_id < y.doc_id")).select(F.col("x.doc_id").alias("id_a"), F.col("y.doc_id").alias("id_b"))
    return across.unionByName(within)


def joined(requirements: DataFrame, t: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """``links`` of requirements by text and boilerplate_main together."""
    return links(W.texts(pick(requirements, "req_id", "text", "boilerplate_main"), "req_id", ["text", "boilerplate_main"]), t)


def found(requirements: DataFrame, t: float = 0.8) -> DataFrame:
    """p2_found: (req_id_a, req_id_b) with a likeness of at least t by text and boilerplate_main together."""
    pairs, members = joined(requirements, t)
    return expanded(pairs, members).toDF("req_id_a", "req_id_b")


def groups(requirements: DataFrame, t: float = 0.8) -> DataFrame:
    """(req_id, group_id) of every row with a near-duplicate: connected components of the links.

    Labels fall to the smallest neighbour and are shortened by a jump each round; only a
    count comes back to the driver.
    """
    docs = W.texts(pick(requirements, "req_id", "text", "boilerplate_main"), "req_id", ["text", "boilerplate_main"])
    pairs, members = links(docs, t)
    pairs = keep(pairs, "links")
    edges = keep(pairs.union(pairs.select("id_b", "id_a")).toDF("u", "v"), "edges")
    label = keep(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("l")), "labels")
    while True:  # labels only fall
        near = edges.join(label.select(F.col("u").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("l2"))
        low = label.join(near, "u").select("u", F.least("l", "l2").alias("l"), F.col("l").alias("was"))
        far = label.select(F.col("u").alias("l"), F.col("l").alias("ll"))
        new = keep(low.join(far, "l", "left").select("u", F.least("l", F.coalesce("ll", "l")).alias("l"), "was"), "labels")
        if new.where("l <> was").limit(1).count() == 0:
            label = new.select("u", "l")
            break
        label = new.select("u", "l")
    single = label.select(F.col("u").alias("rep_id"), F.col("l").alias("group_id"))
    rest = members.select("doc_id", "rep_id").join(single, "rep_id", "full").select(F.coalesce("doc_id", "rep_id").alias("req_id"), F.coalesce("group_id", "rep_id").alias("group_id"))
    return rest
