"""Filling fixed-capacity containers (problem 8): bounded-space online best fit.

Documents are spread over stripes by a seeded hash of their id. Each stripe packs its items
as they come into at most ``OPEN`` open bins per capacity; a bitset keyed by free space gives
the bin with the least room that still fits, and when a bin has to go the fullest closes.
Bins still open at a stripe's end (at most ``OPEN`` a stripe) go on as items, several stripes
together, until the last round has one stripe. Stripes hold a bounded number of documents, so
no task grows with the collection.

Only an item longer than the capacity is cut: into full pieces, each a container of its own,
and a remainder that is packed like any item.

Defined results: null and empty texts have no tokens and no container; a capacity that is
null or below 1 takes nothing; equal free space goes to the bin opened first; the same
document id twice gives two items.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.common import keep, pick, spread
from graphloom.llm import tokens

OPEN = 64
PER_STRIPE = 5_000
MERGE = 32
#: Tasks of a round at most; each then packs several stripes, one after the other.
MOST_TASKS = 20_000
ROW = pa.schema([("spec_id", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int64()), ("n_tokens", pa.int64()), ("bin", pa.int64()), ("open_fill", pa.int64())])
ROW_SQL = "spec_id bigint, doc_id bigint, piece bigint, n_tokens bigint, bin bigint, open_fill bigint"


class Packer:
    """Online best fit with a bounded number of open bins of one capacity."""

    def __init__(self, capacity: int, most_open: int = OPEN):
        self.capacity, self.most_open = capacity, most_open
        self.bits = 0  # bit f is set where a bin with f free is open
        self.free: dict[int, list[int]] = {}
        self.n_open = self.n_bins = 0

    def place(self, size: int) -> int:
        """The number of the bin that takes an item of 1 <= size <= capacity."""
        above = self.bits >> size
        if above:
            f = (above & -above).bit_length() - 1 + size
            b = self._take(f)
        else:
            if self.n_open == self.most_open and size < self.capacity:  # a full bin is never open and needs no place
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            b, f = self.n_bins, self.capacity
            self.n_bins += 1
        if f > size:
            self._put(b, f - size)
        return b

    def _take(self, f: int) -> int:
        q = self.free[f]
        b = q.pop(0)
        if not q:
            del self.free[f]
            self.bits &= ~(1 << f)
        self.n_open -= 1
        return b

    def _put(self, b: int, f: int) -> None:
        self.free.setdefault(f, []).append(b)
        self.bits |= 1 << f
        self.n_open += 1

    def open_bins(self):
        return ((b, self.capacity - f) for f, q in self.free.items() for b in q)


def pieces(size: int, capacity: int):
    """(piece number, tokens): the item itself, or full pieces and the remainder."""
    if size <= capacity:
        return ((0, size),)
    full, rest = divmod(size, capacity)
    return (*((i, capacity) for i in range(full)), *(((full, rest),) if rest else ()))


def _packed(specs: list[tuple[int, int]], most_open: int):
    """Packs the rows (stripe, id, size, spec) of a task, stripe by stripe; spec null: for every spec."""

    def run(batches):
        at, packers, shift = None, {}, 0
        out: list[list] = [[] for _ in ROW]

        def emit(*row):
            for column, v in zip(out, row):
                column.append(v)

        def close():
            for spec, p in packers.items():
                for b, fill in p.open_bins():
                    emit(spec, None, None, None, shift + b, fill)

        def flush():
            nonlocal out
            rows, out = out, [[] for _ in ROW]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, ROW.types)], schema=ROW)

        for b in batches:
            for stripe, item, size, only in zip(*(b.column(i).to_pylist() for i in range(4))):
                if stripe != at:
                    close()
                    at, packers, shift = stripe, {s: Packer(c, most_open) for s, c in specs}, stripe << 32
                for spec, capacity in specs:
                    if only is None or only == spec:
                        for piece, n in pieces(size, capacity):
                            emit(spec, item, piece, n, shift + packers[spec].place(n), None)
            yield flush()
        close()
        yield flush()

    return run


def pack(sizes: DataFrame, specs: DataFrame, seed: int = 1, per_stripe: int = PER_STRIPE, most_open: int = OPEN) -> DataFrame:
    """(spec_id, container, doc_id, piece, n_tokens) for sizes (doc_id, n_tokens) and specs (spec_id, capacity_tokens).

    The specs are the kinds of containers that a user asks for, not data; they go to every task.
    """
    kinds = [(r[0], r[1]) for r in specs.select("spec_id", "capacity_tokens").distinct().orderBy("spec_id").collect() if r[0] is not None and r[1] and r[1] > 0]
    sizes = keep(sizes.where("n_tokens > 0").select("doc_id", "n_tokens"), "sizes")
    stripes = max(1, -(-sizes.count() // per_stripe))
    run = _packed(kinds, most_open)
    # The number of partitions is given: few bytes of many stripes would else be merged into one task.
    one = lambda d, n: d.repartition(min(n, MOST_TASKS), "stripe").sortWithinPartitions("stripe", "h", "item").select("stripe", "item", "size", "spec").mapInArrow(run, ROW_SQL)
    hashed = sizes.withColumn("h", F.xxhash64(F.lit(seed), "doc_id"))
    first = keep(one(hashed.select(F.pmod("h", F.lit(stripes)).alias("stripe"), F.col("doc_id").alias("item"), F.col("n_tokens").alias("size"), F.lit(None).cast("bigint").alias("spec"), "h"), stripes), "packed")
    moved = None  # (spec_id, bin, container): where the bins left open went
    left = first.where("doc_id is null").select("spec_id", "bin", "open_fill")
    base, groups = stripes, stripes
    while groups > 1:
        groups = -(-groups // MERGE)
        item = left.select(F.pmod(F.shiftrightunsigned("bin", 32), F.lit(groups)).alias("g"), "spec_id", "bin", "open_fill")
        merged = keep(one(item.select((F.col("g") + base).alias("stripe"), F.col("bin").alias("item"), F.col("open_fill").alias("size"), F.col("spec_id").alias("spec"), F.xxhash64(F.lit(seed), "bin").alias("h")), groups), "merged")
        step = merged.where("doc_id is not null").select("spec_id", F.col("doc_id").alias("bin"), F.col("bin").alias("container"))
        moved = step if moved is None else moved.alias("m").join(step.alias("s"), F.expr("m.spec_id = s.spec_id and m.container = s.bin"), "left").select("m.spec_id", "m.bin", F.coalesce("s.container", "m.container").alias("container")).unionByName(step)
        left = merged.where("doc_id is null").select("spec_id", "bin", "open_fill")
        base += groups
    rows = first.where("doc_id is not null")
    if moved is None:
        return rows.select("spec_id", F.col("bin").alias("container"), "doc_id", "piece", "n_tokens")
    return rows.join(moved, ["spec_id", "bin"], "left").select("spec_id", F.coalesce("container", "bin").alias("container"), "doc_id", "piece", "n_tokens")


def packed(documents: DataFrame, specs: DataFrame, home: str = tokens.HOME, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    return pack(tokens.counted(spread(pick(documents, "doc_id", "text")), "doc_id", "text", home=home, vocabulary=vocabulary), specs)


def report(rows: DataFrame, specs: DataFrame) -> DataFrame:
    """Per spec: containers, tokens, the unused share and the fewest containers that could do."""
    bins = rows.groupBy("spec_id").agg(F.countDistinct("container").alias("containers"), F.sum("n_tokens").alias("tokens"))
    cap = F.col("capacity_tokens")
    return bins.join(specs.select("spec_id", "capacity_tokens").dropDuplicates(["spec_id"]), "spec_id").select(
        "spec_id", "containers", "tokens", F.ceil(F.col("tokens") / cap).alias("least"), F.round(1 - F.col("tokens") / (F.col("containers") * cap), 4).alias("unused"))


def invariants(rows: DataFrame, sizes: DataFrame, specs: DataFrame) -> DataFrame:
    """What has to hold of a packing, a row per spec: documents packed, tokens lost or added by document, containers
    over their capacity, documents cut without need, pieces that are neither full nor the last, and whether at most 5 % is unused.

    rows as from ``pack``, sizes (doc_id, n_tokens) with unique ids.
    """
    kinds = specs.select("spec_id", F.col("capacity_tokens").alias("cap")).where("spec_id is not null and cap > 0").dropDuplicates(["spec_id"])
    per = rows.groupBy("spec_id", "doc_id").agg(F.sum("n_tokens").alias("got"), F.count("*").alias("pieces"), F.max("piece").alias("last"))
    short = rows.join(kinds, "spec_id").where("n_tokens < cap").groupBy("spec_id", "doc_id").agg(F.count("*").alias("short"))
    docs = per.join(sizes.where("n_tokens > 0"), "doc_id", "full").join(kinds, "spec_id", "left").join(short, ["spec_id", "doc_id"], "left")
    a = docs.groupBy("spec_id").agg(
        F.count("pieces").alias("documents"), F.count_if(~F.col("got").eqNullSafe(F.col("n_tokens"))).alias("changed"),
        F.count_if((F.col("n_tokens") <= F.col("cap")) & (F.col("pieces") > 1)).alias("cut_without_need"), F.count_if(F.col("short") > 1).alias("short_pieces"))
    bins = rows.groupBy("spec_id", "container").agg(F.sum("n_tokens").alias("fill")).join(kinds, "spec_id")
    b = bins.groupBy("spec_id").agg(F.count_if(F.col("fill") > F.col("cap")).alias("over"), (F.sum("fill") >= F.sum("cap") * 0.95).alias("well_filled"))
    return a.join(b, "spec_id")
