"""Word sets of texts and what the similarity joins share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.common import keep, spread

#: Rows up to which a list of ids is broadcast (some 25 MB as a hash relation); beyond it the join is shuffled.
SMALL = 500_000
LEAST_WORDS = 8


#: UTF-8 bytes that are part of a word; all others separate.
_BYTES = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Texts and bytes that are read together; a longer text is read alone.
TEXTS, BYTES = 1 << 14, 1 << 22
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for i, b in enumerate((_BASE, _INVERSE)):
            _powers[i] = np.concatenate([np.ones(1, dtype=np.uint64), np.cumprod(np.full(n - 1, b, dtype=np.uint64))])
    tables = [t[:n] for t in _powers]
    if n > 4 * BYTES:  # do not keep the tables of one huge text
        _powers[:] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]
    return tables


def _sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    buf = np.frombuffer(b" ".join(texts).translate(_BYTES) + b" ", dtype=np.uint8)
    inside = np.concatenate([[False], buf != 32])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    up, down = _power_tables(len(buf))
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(buf.astype(np.uint64) * up)])
    word = mix((total[end] - total[start]) * down[start] + mix((end - start).astype(np.uint64)))
    first = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
    owner = np.searchsorted(first, start, "right").astype(np.uint64) - np.uint64(1)
    both = np.sort((owner << np.uint64(50)) | (word >> np.uint64(14)))
    both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
    owner = (both >> np.uint64(50)).astype(np.int64)
    return mix(both & np.uint64((1 << 50) - 1)), owner, np.bincount(owner, minlength=len(texts))


def word_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, text of each, sizes): the distinct words (maximal runs of a-z and 0-9 in
    the lower-cased text) of each text; a null text has none.

    The bytes of many texts are hashed at once: a word's hash is a difference of prefix sums of
    a polynomial in the byte places, brought back to its start and mixed. Words are told apart
    by 50 bits, within a text or a pair of texts.
    """
    raw = [t.lower().encode("utf-8", "replace") if t else b"" for t in texts]
    parts, at = [], 0
    while at < len(raw):
        to, size = at, 0
        while to < len(raw) and to - at < TEXTS and (to == at or size + len(raw[to]) < BYTES):
            size += len(raw[to]) + 1
            to += 1
        h, owner, n = _sets(raw[at:to])
        parts.append((h, owner + at, n))
        at = to
    if not parts:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def large_enough(ids: np.ndarray, texts: list[str | None], *others: np.ndarray):
    """Word sets of the rows that have at least LEAST_WORDS words: (ids, hashes, owners, sizes, others)."""
    h, owner, n = word_sets(texts)
    keep_ = n >= LEAST_WORDS
    if not keep_.all():
        new = np.cumsum(keep_) - 1
        sel = keep_[owner]
        h, owner, n, ids = h[sel], new[owner[sel]], n[keep_], ids[keep_]
        others = tuple(o[keep_] for o in others)
    return ids, h, owner, n, others


def texts(df: DataFrame, id_col: str, text_cols: list[str], *others: Column) -> DataFrame:
    """(doc_id, txt, the others); rows without an id are left out."""
    return spread(df).select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.concat_ws(" ", *(F.col(f"`{c}`") for c in text_cols)).alias("txt"), *others).where(F.col("doc_id").isNotNull())


def filtered(df: DataFrame, ids: DataFrame, n: int, on: str, how: str) -> DataFrame:
    """Semi or anti join with ``n`` counted ids: broadcast while they are few, shuffled beyond."""
    return df.join(F.broadcast(ids) if n <= SMALL else ids, on, how)


def set_keys(docs: DataFrame, *others: str) -> DataFrame:
    """(doc_id, k1, k2, the others): a 128-bit key of each word set, rows of fewer words left out."""
    kinds = [docs.schema[c] for c in others]
    out = "doc_id bigint, k1 bigint, k2 bigint" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in kinds)

    def run(batches):
        for b in batches:
            ids, h, owner, n, rows = large_enough(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist(), np.arange(b.num_rows))
            keys = []
            for salt in (0x2545F4914F6CDD1D, 0x9E6C63D0676A9A99):
                k = np.zeros(len(ids), dtype=np.uint64)
                np.add.at(k, owner, mix(h ^ np.uint64(salt)))
                keys.append(pa.array(mix(k).view(np.int64)))
            rest = [b.column(2 + i).take(pa.array(rows[0])) for i in range(len(others))]
            yield pa.RecordBatch.from_arrays([pa.array(ids), *keys, *rest], names=["doc_id", "k1", "k2", *others])

    return docs.select("doc_id", "txt", *others).mapInArrow(run, out)


def classes(docs: DataFrame, *others: str) -> tuple[DataFrame, DataFrame, int]:
    """Rows with one word set form a class with its smallest id for representative.

    Returns (members, copies, number of copies): members (doc_id, rep_id, the others) of all
    classes with several rows, copies the ids of the rows that represent no class. Only
    representatives enter a join, so a text that fills a third of all rows counts once there.
    """
    keyed = keep(set_keys(docs, *others), "keyed")
    several = keyed.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = keep(keyed.join(several, ["k1", "k2"]).drop("k1", "k2"), "members")
    copies = members.where("doc_id <> rep_id").select("doc_id")
    return members, copies, copies.count()


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, over arrays."""
    h = h.astype(np.uint64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


#: Pairs that are compared at a time.
BLOCK = 2_000_000


def ranges(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Pairs (i, j) of each of ``rows`` with all of lo <= j < hi, some at a time."""
    n = np.maximum(hi - lo, 0)
    live = n > 0
    rows, lo, n = rows[live], lo[live], n[live]
    upto = np.cumsum(n)
    i = 0
    while i < len(rows):
        done = upto[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(upto, done + BLOCK, "right")))
        c = n[i:j]
        first = np.cumsum(c) - c
        yield np.repeat(rows[i:j], c), np.arange(int(c.sum())) - np.repeat(first - lo[i:j], c)
        i = j


def whole_blocks(batches, names: tuple[str, ...]):
    """Arrays of rows sorted by their first column, cut so that no run of equal keys is split."""
    pending: list[list[np.ndarray]] = []
    for b in batches:
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(len(names))]
        if not len(cols[0]):
            continue
        last = int(np.searchsorted(cols[0], cols[0][-1], "left"))  # where the run that may go on begins
        if pending and pending[0][0][0] != cols[0][-1]:
            pending.append([c[:last] for c in cols])
            yield dict(zip(names, (np.concatenate(x) for x in zip(*pending))))
            pending = [[c[last:] for c in cols]]
        elif not pending:
            if last:
                yield dict(zip(names, (c[:last] for c in cols)))
            pending = [[c[last:] for c in cols]]
        else:
            pending.append(cols)
    if pending:
        yield dict(zip(names, (np.concatenate(x) for x in zip(*pending))))


def bounded_blocks(batches, names: tuple[str, ...], bound: int | None):
    """Blocks of whole runs of equal keys (the first column) of at most ``bound`` rows; a longer run comes
    as {"hot": the second column, "key"}, piece by piece as it is read, so that no run has to fit in memory."""
    pending, size, hot = [], 0, None  # columns of the run that may go on, or its key if it is hot

    def block(cols):
        """The runs of ``cols``, sorted, as one block and the ids of those that are too long."""
        start, end = runs(cols[0])
        long = (end - start) > bound if bound is not None else np.zeros(len(start), bool)
        if long.any():
            yield {"hot": cols[1][long], "key": cols[0][long]}
            cols = [c[~long] for c in cols]
        if len(cols[0]):
            yield dict(zip(names, cols))

    for b in batches:
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(len(names))]
        if not len(cols[0]):
            continue
        if hot is not None:
            same = int(np.searchsorted(cols[0], hot, "right")) if cols[0][0] == hot else 0
            if same:
                yield {"hot": cols[1][:same], "key": cols[0][:same]}
                cols = [c[same:] for c in cols]
            if not len(cols[0]):
                continue
            hot = None
        last = int(np.searchsorted(cols[0], cols[0][-1], "left"))
        if pending and pending[0][0][0] == cols[0][-1]:
            pending.append(cols)
        else:
            pending.append([c[:last] for c in cols])
            yield from block([np.concatenate(x) for x in zip(*pending)])
            pending = [[c[last:] for c in cols]]
        size = sum(len(p[0]) for p in pending)
        if bound is not None and size > bound:
            hot = pending[0][0][0]
            for p in pending:
                yield {"hot": p[1], "key": p[0]}
            pending = []
    if pending:
        yield from block([np.concatenate(x) for x in zip(*pending)])


def runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the run of equal keys that each row is in."""
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([edge, [len(key)]]))
    return np.repeat(edge, size), np.repeat(edge + size, size)


GROUPS, LEVELS = 32, 2


def count_codes(h: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Each row's count vector over 32 token groups, in unary: bit (group, level) is set
    where the group has more than ``level`` tokens. The summed coordinate minima of two
    vectors are then the common bits, but for counts beyond the levels."""
    cell = owner * GROUPS + (mix(h ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(GROUPS)).astype(np.int64)
    counts = np.bincount(cell, minlength=n * GROUPS).reshape(n, GROUPS)
    code = np.zeros(n, dtype=np.uint64)
    for g in range(GROUPS):
        for level in range(LEVELS):
            code |= (counts[:, g] > level).astype(np.uint64) << np.uint64(g * LEVELS + level)
    return code.view(np.int64)


def most_overlap(x: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Upper bound of the overlap: common bits, and what the counts beyond the levels could add."""
    ca, cb = x["code"][i], x["code"][j]
    common = np.bitwise_count(ca & cb).astype(np.int64)
    return common + np.minimum(x["over"][i], x["over"][j])


def prepared(x: dict) -> dict:
    x["code"] = np.ascontiguousarray(x["code"]).view(np.uint64)
    x["n"] = x["n"].astype(np.int64)
    x["over"] = x["n"] - np.bitwise_count(x["code"]).astype(np.int64)
    return x


def may_reach(x: dict, i: np.ndarray, j: np.ndarray, t: float) -> np.ndarray:
    """Sizes and the bounded overlap allow a Jaccard likeness of t."""
    na, nb = x["n"][i], x["n"][j]
    return (np.minimum(na, nb) >= t * np.maximum(na, nb) - 1e-9) & (most_overlap(x, i, j) * (1 + t) >= t * (na + nb) - 1e-9)


PAIRS = "id_a bigint, id_b bigint"


def pair_batch(a: np.ndarray, b: np.ndarray):
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["id_a", "id_b"])


def sorted_words(docs: DataFrame) -> DataFrame:
    """(doc_id, words): the word hashes of each row."""

    def run(batches):
        for b in batches:
            h, _, n = word_sets(b.column(1).to_pylist())
            offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(h.view(np.int64)))], names=["doc_id", "words"])

    return docs.select("doc_id", "txt").mapInArrow(run, "doc_id bigint, words array<bigint>")


def verified(pairs: DataFrame, docs: DataFrame, t: float) -> DataFrame:
    """The pairs (id_a, id_b) whose word sets have a Jaccard likeness of at least t."""
    pairs = keep(pairs, "pairs")
    ids = keep(pairs.select(F.explode(F.array("id_a", "id_b")).alias("doc_id")).distinct(), "ids")
    some = sorted_words(filtered(docs.select("doc_id", "txt"), ids, ids.count(), "doc_id", "left_semi"))
    both = pairs.join(some.select(F.col("doc_id").alias("id_a"), F.col("words").alias("wa")), "id_a").join(some.select(F.col("doc_id").alias("id_b"), F.col("words").alias("wb")), "id_b")
    o = F.size(F.array_intersect("wa", "wb"))
    return both.where(o * (1 + t) >= F.lit(t) * (F.size("wa") + F.size("wb")) - 1e-9).select("id_a", "id_b")
