"""Mixing sources to target weights (problem 9): min-cost flow over membership patterns.

Documents with the same text form a class; the set of sources it occurs in is its membership
pattern. The classes of a pattern are one node, however many patterns there are, whose capacity is their
tokens: the first use of a class costs nothing, each further one more than the last (convex),
and a source takes a class at most ``max_repeats`` times. The flow to the source quotas is
then turned into documents: whole rounds for all, and an interval of the seeded hash ring for
the rest, whose end is found by running sums over ``BUCKETS`` buckets, then over those of the
bucket that holds it, and so on, until few documents are left.

The mixture is the largest that reaches the target shares, or ``total_tokens`` if less.

Defined results: sources without a target, and null ones, take no part; targets that are null
or not above 0 take nothing; null and empty texts have no tokens and are left out; of equal
texts of one source the document with the smallest id stands for all, so copies cannot get
round the cap.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from graphloom.common import keep, pick, spread
from graphloom.llm import tokens

BUCKETS, BITS = 4096, 12
#: With more patterns than these the plan is joined by a shuffle, not by a broadcast.
MOST_PATTERNS = 10_000
#: Documents of a pattern and source that one task looks at for the end of the rest.
MOST_TOGETHER = 10_000


def assigned(members: list[np.ndarray], size: np.ndarray, repeats: list[int], wanted: list[int]) -> list[np.ndarray]:
    """Tokens that each source takes from each of its patterns: min-cost flow, all patterns told apart.

    ``members``: for each source the numbers of its patterns, rising; ``size``: tokens of each pattern.
    A pattern's n-th round costs n - 1, so the cheapest way fills the rounds in order: for each round
    it is a maximal flow that goes on from the last one. Patterns are arrays and paths lead over
    sources only: one that wants tokens takes another's share of patterns that both have, which
    takes its own elsewhere, until one finds patterns with room in this round.
    """
    flow = [np.zeros(len(m), np.int64) for m in members]
    most = [size[m] * r for m, r in zip(members, repeats)]
    load, left = np.zeros(len(size), np.int64), list(wanted)

    def room(s: int, rounds: int) -> np.ndarray:
        """What source s can still take from its patterns in these rounds."""
        m = members[s]
        return np.minimum(most[s] - flow[s], size[m] * rounds - load[m])

    def shared(s: int, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What s can take over from t: places among s's patterns, among t's, tokens."""
        j = np.flatnonzero(flow[t])
        i = np.searchsorted(members[s], members[t][j])
        both = np.flatnonzero(np.append(members[s], -1)[i] == members[t][j])
        i, j = i[both], j[both]
        return i, j, np.minimum(most[s][i] - flow[s][i], flow[t][j])

    def path(rounds: int) -> tuple[list[int], int]:
        """Sources of a shortest path, and how much can go along it."""
        able = [s for s, n in enumerate(left) if n]
        via, limit = dict.fromkeys(able), {s: left[s] for s in able}
        for s in able:  # grows on the way
            free = int(room(s, rounds).sum())
            if free:
                limit[s], out = min(limit[s], free), [s]
                n = limit[s]
                while via[out[0]] is not None:
                    out.insert(0, via[out[0]])
                return out, n
            for t in range(len(members)):
                if t not in via and (n := int(shared(s, t)[2].sum())):
                    via[t], limit[t] = s, min(limit[s], n)
                    able.append(t)
        return [], 0

    for rounds in range(1, sum(repeats) + 1):
        while any(left):
            way, n = path(rounds)
            if not way:
                break
            last = way[-1]
            got = _first(room(last, rounds), n)
            flow[last] += got
            load[members[last]] += got
            for s, t in reversed(list(zip(way, way[1:]))):
                i, j, most_moved = shared(s, t)
                got = _first(most_moved, n)
                flow[s][i] += got
                flow[t][j] -= got
            left[way[0]] -= n
    return flow


def _first(room: np.ndarray, n: int) -> np.ndarray:
    """n in all, from the first places on; at most one place is filled in part."""
    before = np.cumsum(room) - room
    return np.clip(n - before, 0, room)


def planned(numbers: np.ndarray, width: np.ndarray, size: np.ndarray, targets: list[tuple[float, int]], total: int | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(members, flow) as in ``assigned``, of the largest mixture that reaches the shares, or one of ``total`` tokens.

    ``numbers``: the sources of all patterns, one pattern after the other; ``width``: how many each has. Targets are (share, most repeats).
    """
    # Patterns of few sources first: they serve no one else.
    order = np.argsort(width, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    of = np.repeat(place, width)
    members = [np.sort(of[numbers == s]) for s in range(len(targets))]
    most = [r * int(size[order][m].sum()) for m, (_, r) in zip(members, targets)]
    reach = min((int(n / share) for n, (share, _) in zip(most, targets)), default=0)
    total = reach if total is None else min(total, reach)
    flow = assigned(members, size[order], [r for _, r in targets], [round(share * total) for share, _ in targets])
    return [order[m] for m in members], flow


def route(capacity: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[tuple[tuple[str, ...], str], int]:
    """Tokens from each membership pattern to each of its sources."""
    names, patterns = sorted(targets), sorted(capacity)
    at = {s: i for i, s in enumerate(names)}
    numbers = np.fromiter((at[s] for s in chain.from_iterable(patterns)), np.int64)
    width, size = np.array([len(p) for p in patterns], np.int64), np.array([capacity[p] for p in patterns], np.int64)
    members, flow = planned(numbers, width, size, [targets[s] for s in names], total)
    return {(patterns[p], s): n for s, m, f in zip(names, members, flow) for p, n in zip(m.tolist(), f.tolist())}


def units(documents: DataFrame, targets: DataFrame, home: str, vocabulary: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, n_tokens, number, pattern, h) of every document that can be used, and (pattern, sources, size) of every pattern. ``targets``: source and its number."""
    src = spread(pick(documents, "doc_id", "source", "text")).where(F.col("text").isNotNull())
    src = src.join(F.broadcast(targets.select("source", "number")), "source").withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(7), "text")})
    sized = tokens.counted(src, "doc_id", "text", "source", "number", "k1", "k2", home=home, vocabulary=vocabulary).where("n_tokens > 0")
    one = keep(sized.groupBy("k1", "k2", "source", "number").agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens")), "units")
    # A class occurs in few sources; the aggregate holds their numbers, never documents.
    of_class = one.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("number")).alias("sources"), F.max("n_tokens").alias("size"))
    patterns = keep(of_class.groupBy("sources").agg(F.sum("size").alias("size")).withColumn("pattern", F.monotonically_increasing_id()), "patterns")
    own = of_class.drop("size").join(patterns.drop("size"), "sources").drop("sources")
    return keep(one.join(own, ["k1", "k2"]).withColumn("h", F.xxhash64(F.lit(11), "k1", "k2")), "units"), patterns


def _bucket(level: int, start=None):
    """The place of a document's hash at a level: its next BITS bits; the ring turns at the first level only."""
    b = F.pmod(F.shiftrightunsigned("h", BITS * level), F.lit(BUCKETS))
    return b if start is None else F.pmod(b - start, F.lit(BUCKETS))


def chosen(rows: DataFrame) -> DataFrame:
    """rows (pattern, source, doc_id, n_tokens, h, start, rest) with ``more``: 1 for those that make up ``rest``, in ring order from ``start``.

    Whole buckets are taken until one holds the end of the rest; that one is looked at by its next
    bits, until a task can sort it. The document in which the rest ends is taken if that brings the sum nearer to it.
    """
    key = ["pattern", "source"]
    done, level = [], 0
    rows = rows.withColumn("rest", F.col("rest").cast("bigint"))
    while True:
        placed = rows.withColumn("place", _bucket(level, F.col("start") if level == 0 else None))
        hist = placed.groupBy(*key, "place").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs"), F.first("rest").alias("rest"))
        w = Window.partitionBy(*key).orderBy("place")  # BUCKETS rows at most
        cut = hist.withColumn("before", F.sum("n").over(w) - F.col("n")).where("before < rest").groupBy(*key).agg(F.max("place").alias("cut"), F.max("before").alias("before"), F.max_by("docs", "place").alias("docs"))
        cut = keep(cut, "cut")
        at = placed.join(cut.drop("docs"), key, "left")
        done.append(at.where("cut is null or place <> cut").withColumn("more", F.expr("coalesce(place < cut, false)").cast("bigint")))
        rows = at.where("place = cut").withColumn("rest", F.col("rest") - F.col("before")).drop("place", "cut", "before")
        most = cut.agg(F.max("docs")).first()[0] or 0
        if most > MOST_TOGETHER:
            rows = keep(rows, "cut_rows")
        level += 1
        if most <= MOST_TOGETHER or (level + 1) * BITS > 64:
            break
    run = Window.partitionBy(*key).orderBy("h", "doc_id")
    last = rows.withColumn("upto", F.sum("n_tokens").over(run)).withColumn("more", F.expr("upto - n_tokens / 2.0 <= rest").cast("bigint"))
    cols = ["doc_id", "source", "n_tokens", "rounds", "more"]
    out = last.select(cols)
    for d in done:
        out = out.unionByName(d.select(cols))
    return out


def plan_of(patterns: DataFrame, targets: list[tuple[float, int]], total: int | None) -> tuple[pa.Table, int]:
    """(pattern, number, rounds, start, rest) of all that is taken, as arrays, and how many patterns there are.

    The driver holds some hundred bytes for each pattern and source of it, whatever the documents.
    """
    got = patterns.toArrow()
    lists, key, size = got["sources"], got["pattern"].to_numpy(), got["size"].to_numpy()
    numbers, width = pc.list_flatten(lists).to_numpy(), pc.list_value_length(lists).to_numpy().astype(np.int64)
    present, numbers = np.unique(numbers, return_inverse=True)
    members, flow = planned(numbers, width, size, [targets[s] for s in present], total)
    before = np.zeros(len(key), np.int64)  # tokens of a pattern's ring that other sources took
    cols: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(5)]
    for s, m, f in zip(present, members, flow):
        m, f = m[f > 0], f[f > 0]
        rounds, rest = np.divmod(f, size[m])
        for c, x in zip(cols, (key[m], np.full(len(m), s), rounds, before[m] % size[m] * BUCKETS // size[m], rest)):
            c.append(x)
        before[m] += rest
    return pa.table({c: pa.array(np.concatenate(x), pa.int64()) for c, x in zip(("pattern", "number", "rounds", "start", "rest"), cols)}), len(key)


def mixture(documents: DataFrame, mix_targets: DataFrame, total_tokens: int | None = None, home: str = tokens.HOME, vocabulary: str = tokens.VOCABULARY, most_patterns: int = MOST_PATTERNS) -> DataFrame:
    """(doc_id, source, n_tokens, uses), uses at least 1 and at most the source's max_repeats."""
    spark = documents.sparkSession
    # The targets are what a user asks for, not data.
    small = pick(mix_targets, "source", "target_share", "max_repeats").where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    targets = sorted(tuple(r) for r in small.collect())
    known = spark.createDataFrame([(s, i) for i, (s, _, _) in enumerate(targets)], "source string, number bigint")
    all_units, patterns = units(documents, known, home, vocabulary)
    plan, n = plan_of(patterns, [t[1:] for t in targets], total_tokens)
    table = spark.createDataFrame(plan)
    uses = chosen(all_units.join(F.broadcast(table) if n <= most_patterns else table, ["pattern", "number"]))
    return uses.select("doc_id", "source", "n_tokens", (F.col("rounds") + F.col("more")).alias("uses")).where("uses > 0")


def shares(rows: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """Per target source: documents, uses, tokens, target and actual share."""
    got = rows.groupBy("source").agg(F.count("*").alias("docs"), F.sum("uses").alias("uses"), F.sum(F.col("uses") * F.col("n_tokens")).alias("tokens"), F.max("uses").alias("most_uses"))
    all_ = F.sum(F.coalesce("tokens", F.lit(0))).over(Window.partitionBy(F.lit(1)))  # a row per target source
    return mix_targets.select("source", "target_share", "max_repeats").join(got, "source", "left").select(
        "source", "target_share", "max_repeats", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("docs", "uses", "tokens", "most_uses")),
        F.round(F.coalesce("tokens", F.lit(0)) / all_, 4).alias("actual_share"))


def invariants(rows: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """What has to hold of a mixture, a row per target source: no document used more often than allowed, and a share within 0.5 % of the target."""
    got = shares(rows, mix_targets)
    return got.select("source", "max_repeats", (F.col("most_uses") > F.col("max_repeats")).alias("over"), (F.abs(F.col("actual_share") - F.col("target_share")) <= 0.005).alias("near"))
