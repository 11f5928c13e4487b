"""The most similar vectors of every vector, by a permutation index.

Vectors are represented by their nearest pivots in order and posted in those pivots' inverted files, which bring together
what may be similar, once, with its vectors (a link component). There a vector's candidates are those it shares lists with,
ranked by Spearman's footrule between the orders; its shortlist is reranked by exact cosines. An exact check follows: what is
not on the shortlist, but by its sketch may be closer than the k-th of it, is compared too. Where no more than a
shortlist was brought together, all of it is reranked.

Where one link component is larger than a block, it is cut into blocks and each pair of blocks is worked at by itself, so
that the check covers all its pairs whatever its size; that work grows with the square of the component.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm import vectors as V
from quillspark.session import ship_package, written

OUT = "sha string, other string, similarity double"
OUT_ARROW = pa.schema([("sha", pa.string()), ("other", pa.string()), ("similarity", pa.float64())])


def shared_ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of two arrays of nearest pivots, what lessens their footrule distance: ``footrule = m * (m + 1) - 2 * shared``.

    Worked out list by list, so only rows with a list in common meet; 0 for others.
    """
    m = a.shape[1]
    out = np.zeros((len(a), len(b)), np.int16)
    order_a, order_b = np.argsort(a, axis=None, kind="stable"), np.argsort(b, axis=None, kind="stable")
    lists, start = np.unique(a.ravel()[order_a], return_index=True)
    end = np.r_[start[1:], a.size]
    others = b.ravel()[order_b]
    from_, to = np.searchsorted(others, lists), np.searchsorted(others, lists, side="right")
    for s, e, p, q in zip(start, end, from_, to, strict=True):
        if p < q:
            x, y = order_a[s:e], order_b[p:q]
            out[np.ix_(x // m, y // m)] += (m - np.maximum.outer(x % m, y % m)).astype(np.int16)
    return out


def _top(i: np.ndarray, j: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the ``k`` of greatest ``s`` of their row ``i``, equal ones by the smaller ``j``, in that order."""
    order = np.lexsort((j, -s, i))
    first = np.r_[True, i[order][1:] != i[order][:-1]] if len(i) else np.zeros(0, bool)
    return order[np.arange(len(i)) - np.maximum.accumulate(np.where(first, np.arange(len(i)), 0)) < k]


def _cosines(x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of pairs, to twelve digits, so that copies of a vector are exactly equal."""
    return np.concatenate([np.zeros(0), *[np.round(np.einsum("ij,ij->i", x[i[s : s + 16384]], x[j[s : s + 16384]]), 12) for s in range(0, len(i), 16384)]])


def nearest_of(x: np.ndarray, near: np.ndarray, left: np.ndarray, right: np.ndarray, k: int, threshold: float, shortlist: int, check: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``i, j, similarity``: the ``k`` best in ``right`` of each row in ``left`` (positions in ``x``); ties to the earlier row."""
    if len(right) <= shortlist + 1:
        sims = np.round(x[left] @ x[right].T, 12)
        sims[left[:, None] == right[None, :]] = -2.0
        i, j = np.nonzero(sims >= threshold)
        keep = _top(i, j, sims[i, j], k)
        return left[i[keep]], right[j[keep]], sims[i[keep], j[keep]]
    shared = shared_ranks(near[left], near[right])
    shared[left[:, None] == right[None, :]] = 0
    small = V.sketch(x.astype(np.float32)).astype(np.float32)
    small /= np.maximum(np.linalg.norm(small, axis=1, keepdims=True), 1e-12)
    out = []
    for at in range(0, len(left), 512):
        mine, score = left[at : at + 512], shared[at : at + 512]
        # The shortlist: least footrule distance first, of equal ones the earlier row.
        listed = np.argpartition(np.arange(len(right)) - score.astype(np.int64) * len(right), shortlist - 1, axis=1)[:, :shortlist]
        i, c = np.nonzero(np.take_along_axis(score, listed, 1) > 0)
        j = listed[i, c]
        s = _cosines(x, mine[i], right[j])
        if check:
            best = _top(i, j, s, k)
            count = np.bincount(i[best], minlength=len(mine))
            last = np.full(len(mine), threshold)
            np.minimum.at(full := np.full(len(mine), 2.0), i[best], s[best])
            last[count == k] = np.maximum(full[count == k], threshold)
            floor = last - V.SKETCH_SIGMAS * (1 - last * last) / math.sqrt(V.SKETCH_DIM) - 0.005  # sketches are rounded
            more = small[mine] @ small[right].T >= floor[:, None]
            more[mine[:, None] == right[None, :]] = False
            more[i, j] = False
            many = more.sum(axis=1) * 50 > len(right)
            whole = np.round(x[mine[many]] @ x[right].T, 12)  # cheaper than pair by pair
            whole[~more[many]] = -2.0
            i1, j1 = np.nonzero(whole >= np.maximum(last[many], np.partition(whole, -k, axis=1)[:, -k] if len(whole) else 0.0)[:, None])
            i2, j2 = np.nonzero(more & ~many[:, None])
            i, j, s = np.r_[i, np.flatnonzero(many)[i1], i2], np.r_[j, j1, j2], np.r_[s, whole[i1, j1], _cosines(x, mine[i2], right[j2])]
        ok = s >= threshold
        i, j, s = i[ok], j[ok], s[ok]
        keep = _top(i, j, s, k)
        out.append((mine[i[keep]], right[j[keep]], s[keep]))
    return tuple(np.concatenate([o[n] for o in out]) for n in range(3))


def rerank(k: int, threshold: float, shortlist: int, check: bool = True) -> Callable[[dict[str, np.ndarray]], list[np.ndarray]]:
    """The ``k`` best of each row of a component or a pair of blocks, whose rows come ordered by content."""

    def work(rows: dict[str, np.ndarray]) -> list[np.ndarray]:
        shas, x, near = rows["sha"], V.unit(V.unpack(rows["vector"])), rows["near"]
        every = np.arange(len(shas))
        sides = [(every, every)]
        if "side" in rows and rows["side"].any():
            a, b = np.flatnonzero(rows["side"] == 0), np.flatnonzero(rows["side"] == 1)
            sides = [(a, b), (b, a)] if len(a) else []
        got = [nearest_of(x, near, a, b, k, threshold, shortlist, check) for a, b in sides]
        i, j, s = (np.concatenate([np.zeros(0, int if n < 2 else float), *[g[n] for g in got]]) for n in range(3))
        return [shas[i], shas[j], s]

    return work


def nearest(embeddings: DataFrame, k: int = 5, threshold: float = 0.78, lists: int = 6, shortlist: int = 64, block: int = 4096, check: bool = True) -> DataFrame:
    """``content_sha256, neighbour_sha256, similarity, place``: up to ``k`` most similar other contents of each, of at least ``threshold``.

    Usable vectors as in ``cluster_vectors``; equal similarities (to twelve digits) are ordered by the smaller content.
    Contents without a neighbour or a usable vector don't come out; an empty table gives no rows. Without ``check``, only
    what is on a shortlist can come out.
    """
    ship_package(embeddings.sparkSession)
    rows = V.usable_rows(embeddings)
    sig = V.signatures(rows, lists)
    roots = V.components(V.candidate_links(sig, threshold))
    linked = sig.join(roots, "id").select("id", "sha", "at", "vh", "near", "root")
    sizes = linked.groupBy("root").agg(F.count("*").alias("n"))
    placed = written(linked.join(sizes, "root"))
    work = rerank(k, threshold, shortlist, check)
    small = V.with_vectors(rows, placed.where(F.col("n") <= block)).select("root", "sha", "near", "vector").repartition("root").sortWithinPartitions("root", "sha")
    out = small.mapInArrow(V.grouped(["root"], work, OUT_ARROW), OUT)
    if placed.where(F.col("n") > block).take(1):
        large = V.with_vectors(rows, placed.where(F.col("n") > block)).select("root", "id", "sha", "near", "vector")
        key = ["root", "a", "b"]
        cells = V.in_block_pairs(written(large), ["root"], "id", block).select(*key, "side", "sha", "near", "vector")
        out = out.unionByName(cells.repartition(*key).sortWithinPartitions(*key, "sha").mapInArrow(V.grouped(key, work, OUT_ARROW), OUT))
    by = Window.partitionBy("sha").orderBy(F.col("similarity").desc(), "other")
    return out.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k).select(F.col("sha").alias("content_sha256"), F.col("other").alias("neighbour_sha256"), "similarity", "place")
