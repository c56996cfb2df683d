"""Comparisons that p2 makes under its keys: python tests/llm/work.py DIR [BOUND].

Prints, for the distinct texts of DIR/requirements.parquet, the rows, the entries, the largest key,
the pairs under all keys, and what the first round compares: boxes and points under keys of at
most BOUND rows, and the rows that go on to the next round. It also packs all points into one tree of
boxes and prints the share of its leaves a query has to visit.
"""

import os
import sys

import numpy as np
import pyarrow.parquet as pq

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
from graphloom.llm import neardup as N  # noqa: E402
from graphloom.llm import words as W  # noqa: E402


def entries(h, owner, size, t, depth):
    bounds = N.size_bounds(t, int(size.max()))
    own = np.searchsorted(bounds, size, "right") - 1
    keys, at, small = [], [], []
    for down in (0, 1):
        cls = own - down
        most = np.where(cls >= 0, bounds[np.maximum(cls, 0) + 1] - 1, 0)
        depths = np.array([N.depth_of(int(x), t, depth) for x in most])
        for d in np.unique(depths[cls >= 0]):
            mine = (cls >= 0) & (depths == d)
            new, sel = np.cumsum(mine) - 1, mine[owner]
            groups = np.floor(most[mine] * (1 - t) / t + 1e-9).astype(np.int64) + 1 + int(d)
            k, r = N.group_keys(h[sel], new[owner[sel]], groups, cls[mine], int(d))
            keys.append(k)
            at.append(np.flatnonzero(mine)[r])
            small.append(np.full(len(k), 1 - down, np.int8))
    return np.concatenate(keys), np.concatenate(at), np.concatenate(small)


def main(folder: str, bound: int = N.BOUND, t: float = 0.8) -> None:
    table = pq.read_table(f"{folder}/requirements.parquet", columns=["text", "boilerplate_main"]).to_pydict()
    texts = [" ".join(x for x in p if x is not None) for p in zip(table["text"], table["boilerplate_main"])]
    texts = sorted({" ".join(sorted(set(W_.split()))) for W_ in ("".join(c if c.isascii() and c.isalnum() else " " for c in x.lower()) for x in texts)})
    _, h, owner, size, _ = W.large_enough(np.arange(len(texts)), texts)
    code = W.count_codes(h, owner, len(size))
    key, at, small = entries(h, owner, size, t, 1)
    order = np.lexsort((size[at], key))
    key, at, small = key[order], at[order], small[order]
    start, end = W.runs(key)
    n = (end - start)[np.unique(start)]
    print(f"rows {len(size)}, entries {len(key)}, largest key {n.max()}, pairs under all keys {int((n * (n - 1) // 2).sum())}")
    ok = end - start <= bound
    x = W.prepared({"key": key[ok], "id": at[ok], "n": size[at[ok]].astype(np.int32), "small": small[ok], "code": code[at[ok]]})
    box = N.leaves(x)
    rows, boxes, points = np.arange(len(x["key"])), 0, 0
    for i, k in W.ranges(rows, box["of"], box["last"][box["of"]]):
        boxes += len(i)
        hit = N.box_may_reach(x, box, i, k, t)
        i, k = i[hit], k[hit]
        points += int(np.maximum(box["end"][k] - np.maximum(i + 1, box["at"][k]), 0).sum())
    print(f"first round: boxes {boxes}, points {points}; rows that go on {len(np.unique(at[~ok]))}")
    whole = W.prepared({"key": np.zeros(len(size), np.int64), "id": np.arange(len(size)), "n": size.astype(np.int32), "small": np.ones(len(size), np.int8), "code": code})
    by = np.lexsort((whole["code"], whole["n"]))
    whole = {k: v[by] for k, v in whole.items()}
    box = N.leaves(whole)
    some = np.arange(0, len(size), max(1, len(size) // 500))
    i, k = np.repeat(some, len(box["at"])), np.tile(np.arange(len(box["at"])), len(some))
    fits = (box["most"][k] >= t * whole["n"][i]) & (whole["n"][i] >= t * box["least"][k])
    print(f"one tree over all: {N.box_may_reach(whole, box, i, k, t).mean():.3f} of all leaves visited, {N.box_may_reach(whole, box, i, k, t)[fits].mean():.3f} of those of fitting sizes")


if __name__ == "__main__":
    main(sys.argv[1], *(int(a) for a in sys.argv[2:]))
