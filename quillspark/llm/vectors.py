"""What the vector operators share: usable vectors, pivots, permutation signatures, pivot inverted files and link components.

Every vector is looked at twice: once in a scan that turns it into a signature (its nearest pivots in order, and a
128-byte sketch), and once when vectors that may be similar are brought together for exact arithmetic. In between only
signatures travel, so a vector itself crosses the network at most twice, however many posting lists it is in.

Pivots are found in two steps, so that a vector isn't compared with all of them: about 2 * sqrt(pivots) of them lead, each
pivot stands under its two nearest leaders, and a vector is compared with the pivots under its sixteen nearest leaders. With
4 * sqrt(n) pivots a scan then costs in the order of n ** 1.25.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.session import drop_written, written

DIM = 384
#: Pivots are never more than this (some 270 million vectors): at 384 floats the broadcast stays under 100 MB.
MAX_PIVOTS = 65_536
#: Leaders whose pivots a vector is compared with, and leaders that a pivot stands under.
LEADERS, UNDER = 16, 2
SKETCH_DIM = 128
#: Vectors at cosine s have sketches whose cosine spreads by (1 - s * s) / sqrt(SKETCH_DIM) around s.
SKETCH_SIGMAS = 3.0


def usable(column: str = "embedding", dim: int = DIM) -> Column:
    """Exactly ``dim`` finite numbers that aren't all zero. A null array or element, NaN or infinity makes a vector unusable."""
    v = F.col(column)
    high, low = F.array_max(v), F.array_min(v)  # NaN is greater than any number
    whole = ~F.array_contains(v, F.lit(float("inf")).cast("float"))  # null if an element is null
    return F.coalesce((F.size(v) == dim) & whole & ~F.isnan(high) & (low > float("-inf")) & ((high != 0) | (low != 0)), F.lit(False))


def usable_rows(embeddings: DataFrame) -> DataFrame:
    """``sha, at, embedding`` of the rows that can count. A null content_sha256 can't; a null generated_at is the oldest."""
    return embeddings.where(F.col("content_sha256").isNotNull() & usable()).select(F.col("content_sha256").alias("sha"), F.coalesce(F.unix_micros("generated_at"), F.lit(-(2**63))).alias("at"), F.col("embedding").cast("array<float>").alias("embedding"))


def unit(rows: np.ndarray | list) -> np.ndarray:
    """Vectors of length one in double precision."""
    x = np.asarray(rows, dtype=np.float64) if isinstance(rows, np.ndarray) and rows.ndim == 2 else np.stack(list(rows)).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small numbers would over- or underflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@lru_cache(maxsize=1)
def _codec() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(vectors: np.ndarray) -> list[bytes]:
    """Rows, lossless: bytes of equal significance side by side, then zstd. Floats of limited precision shrink to a third."""
    x = np.ascontiguousarray(np.atleast_2d(vectors), dtype="<f4")
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1, 4).transpose(0, 2, 1)).reshape(len(x), -1)
    compress = _codec()[0].compress
    return [compress(r.tobytes()) for r in planes]


def unpack(blobs) -> np.ndarray:
    """The rows that ``pack`` made blobs of."""
    decompress = _codec()[1].decompress
    planes = np.frombuffer(b"".join([decompress(b) for b in blobs]), dtype=np.uint8).reshape(len(blobs), 4, -1)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).reshape(len(blobs), -1).view("<f4")


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length, none of them null, as rows of an array."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, DIM)


def pivot_count(n: int) -> int:
    """About 4 * sqrt(n): lists then hold in the order of sqrt(n) vectors."""
    return max(16, min(MAX_PIVOTS, math.ceil(4 * math.sqrt(max(n, 1)))))


def sample_pivots(rows: DataFrame) -> np.ndarray:
    """A sample of the different vectors, by their hash, so copies don't count more than once. Bounded by ``MAX_PIVOTS``.

    Pivots follow the density of the data: a dense group gets many, so its posting lists are no longer than others.
    """
    hashed = rows.select(F.xxhash64("embedding").alias("h"), "embedding")
    n = hashed.agg(F.approx_count_distinct("h", 0.02)).head()[0]
    share = min(1.0, pivot_count(n) / max(n, 1))
    limit = min(2**63 - 1, -(2**63) + int(share * 2**64))
    found = hashed.where(F.col("h") <= limit).dropDuplicates(["h"]).orderBy("h").limit(2 * MAX_PIVOTS).toArrow()
    if not found.num_rows:
        found = hashed.orderBy("h").limit(16).toArrow()
    return unit(matrix(found.column("embedding").combine_chunks())).astype(np.float32) if found.num_rows else np.zeros((0, DIM), np.float32)


def projection(dim: int = DIM, out: int = SKETCH_DIM, seed: int = 7) -> np.ndarray:
    """Random orthonormal directions; the same everywhere."""
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return np.ascontiguousarray(q[:, :out], dtype=np.float32)


class Pivots:
    """Pivots under their leaders. A leader is a pivot too; all are compared where there are no more than ``LEADERS``."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        n = len(pivots)
        self.leaders = pivots[: min(n, 2 * math.ceil(math.sqrt(n)))]
        near = _best(pivots @ self.leaders.T, min(UNDER, len(self.leaders))) if n else np.zeros((0, 0), int)
        self.under = [np.flatnonzero((near == g).any(axis=1)) for g in range(len(self.leaders))]

    def nearest(self, x: np.ndarray, m: int) -> np.ndarray:
        """Numbers of the ``m`` nearest pivots of each row of ``x``, in order."""
        led = _best(x @ self.leaders.T, min(LEADERS, len(self.leaders)))
        ids = np.full((*led.shape, m), -1, np.int64)
        sims = np.full((*led.shape, m), -2.0, np.float32)
        for g in np.unique(led):
            under = self.under[g]
            row, slot = np.nonzero(led == g)
            s = x[row] @ self.pivots[under].T
            k = min(m, len(under))
            best = _best(s, k)
            ids[row, slot, :k] = under[best]
            sims[row, slot, :k] = np.take_along_axis(s, best, 1)
        ids, sims = ids.reshape(len(x), -1), sims.reshape(len(x), -1)
        by_id = np.argsort(ids, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, by_id, 1), np.take_along_axis(sims, by_id, 1)
        sims[:, 1:][ids[:, 1:] == ids[:, :-1]] = -2.0  # found under another leader too
        return np.take_along_axis(ids, _best(sims, min(m, len(self.pivots))), 1)


def _best(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` greatest of each row, in order."""
    if k < sims.shape[1]:
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    else:
        near = np.broadcast_to(np.arange(sims.shape[1]), sims.shape)
    return np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, 1), axis=1, kind="stable"), 1)


def sketch(x: np.ndarray) -> np.ndarray:
    s = x @ projection()
    s /= np.maximum(np.abs(s).max(axis=1, keepdims=True), 1e-12)
    return np.rint(s * 127).astype(np.int8)


def _fixed_lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))


def _signatures(pivots, m: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 2048):
                part = b.slice(at, 2048)
                x = unit(matrix(part.column("embedding"))).astype(np.float32)
                near = pivots.value.nearest(x, m).astype(np.int32)
                sketches = pa.array([r.tobytes() for r in sketch(x)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("sha"), part.column("at"), part.column("vh"), _fixed_lists(near), sketches], ["sha", "at", "vh", "near", "sketch"])

    return run


def signatures(rows: DataFrame, m: int) -> DataFrame:
    """``id, sha, at, vh, near, sketch`` of the newest usable row of each content, written once so that ids are stable.

    Of rows generated at one time that with the greater vector hash ``vh`` holds.
    """
    spark = rows.sparkSession
    pivots = spark.sparkContext.broadcast(Pivots(sample_pivots(rows)))
    schema = "sha string, at long, vh long, near array<int>, sketch binary"
    if len(pivots.value.pivots) == 0:
        return spark.createDataFrame([], "id long, " + schema)
    sig = rows.select("sha", "at", F.xxhash64("embedding").alias("vh"), "embedding").mapInArrow(_signatures(pivots, m), schema)
    newest = sig.groupBy("sha").agg(F.max(F.struct("at", "vh", "near", "sketch")).alias("s"))
    return written(newest.select(F.monotonically_increasing_id().alias("id"), "sha", "s.at", "s.vh", "s.near", "s.sketch"))


def footrule(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Spearman's footrule between rows of two arrays of nearest pivots; a pivot that is missing counts as ranked m + 1."""
    m = a.shape[1]
    shared = np.zeros(len(a), np.int32)
    for i in range(m):
        for j in range(m):
            shared += (a[:, i] == b[:, j]) * (m - max(i, j))
    return m * (m + 1) - 2 * shared


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest position linked to each of ``n`` positions, directly or through others, over links (i, j)."""
    label = np.arange(n)
    while len(i):
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        while True:
            nxt = low[low]
            if np.array_equal(nxt, low):
                break
            low = nxt
        if np.array_equal(low, label):
            break
        label = low
    return label


def sketch_floor(threshold: float) -> float:
    return threshold - SKETCH_SIGMAS * (1 - threshold * threshold) / math.sqrt(SKETCH_DIM)


def dense_roots(linked: np.ndarray) -> np.ndarray:
    """The smallest position linked to each row of a symmetric matrix of links, directly or through others."""
    n = len(linked)
    label = np.arange(n, dtype=np.int32)
    while True:
        low = label.copy()
        for at in range(0, n, 1024):
            part = np.where(linked[at : at + 1024], label[None, :], n).min(axis=1)
            low[at : at + 1024] = np.minimum(low[at : at + 1024], part)
        low = _jump(low)
        if np.array_equal(low, label):
            return label
        label = low


def two_sided_roots(linked: np.ndarray) -> np.ndarray:
    """The same for links between rows and columns; columns are numbered after rows."""
    r, c = linked.shape
    label = np.arange(r + c, dtype=np.int32)
    while True:
        low = label.copy()
        for at in range(0, r, 1024):
            rows = slice(at, min(at + 1024, r))
            part = linked[rows]
            low[rows] = np.minimum(low[rows], np.where(part, label[None, r:], r + c).min(axis=1, initial=r + c))
            low[r:] = np.minimum(low[r:], np.where(part, label[rows, None], r + c).min(axis=0, initial=r + c))
        low = _jump(low)
        if np.array_equal(low, label):
            return label
        label = low


def _jump(label: np.ndarray) -> np.ndarray:
    label = label[label]
    while not np.array_equal(nxt := label[label], label):
        label = nxt
    return label


def _cell_links(floor: float) -> Callable:
    """Links of one posting list: each member with the root of those it may be similar to."""

    def work(cell: dict[str, np.ndarray]) -> list[np.ndarray] | None:
        ids, side = cell["id"], cell["side"]
        if len(ids) < 2:
            return None
        s = cell["sketch"].astype(np.float32)
        s /= np.maximum(np.linalg.norm(s, axis=1, keepdims=True), 1e-12)
        if side.any():
            order = np.argsort(side, kind="stable")
            ids, s, cut = ids[order], s[order], int((side == 0).sum())
            root = two_sided_roots(s[:cut] @ s[cut:].T >= floor)
        else:
            root = dense_roots(s @ s.T >= floor)
        other = np.flatnonzero(root != np.arange(len(ids)))
        u, v = ids[other], ids[root[other]]
        return [np.maximum(u, v), np.minimum(u, v)] if len(other) else None

    return work


def in_block_pairs(rows: DataFrame, key: list[str], id: str, block: int) -> DataFrame:  # noqa: A002
    """``rows`` with ``a, b, side``: a group of more than ``block`` rows is cut into blocks by the hash of ``id``, and each row goes to every pair (a, b) its block is in.

    ``side`` is 0 for rows of block a and 1 for those of another block b. Smaller groups are the one pair (0, 0). So each
    two rows of a group meet in exactly one place, and no place holds more than about two blocks.
    """
    sizes = rows.groupBy(*key).count().where(F.col("count") > block).select(*key, F.ceil(F.col("count") / F.lit(block)).cast("int").alias("_k"))
    own = F.pmod(F.xxhash64(id), F.col("_k")).cast("int")
    each = F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda x: F.struct(F.least(x, own).alias("a"), F.greatest(x, own).alias("b"), F.when(own > x, 1).otherwise(0).alias("side")))
    single = F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("side")))
    return rows.join(sizes, key, "left").select("*", F.inline(F.when(F.col("_k").isNull(), single).otherwise(each))).drop("_k")


LINK = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def candidate_links(sig: DataFrame, threshold: float, block: int = 4096) -> DataFrame:
    """``u, v`` (u > v): links that connect all vectors which share a posting list and whose sketches may reach ``threshold``.

    A list gives at most one link per member, never its pairs. Copies of one vector are one entry. A list of more than
    ``block`` entries is cut into blocks, and each pair of blocks is worked at by itself, so that nothing is lost and nothing
    holds more than two blocks.
    """
    one = sig.groupBy("vh").agg(F.min(F.struct("id", "near", "sketch")).alias("s")).select("vh", "s.*")
    posts = one.select(F.explode("near").alias("pivot"), "id", "sketch")
    key = ["pivot", "a", "b"]
    posts = in_block_pairs(posts, ["pivot"], "id", block).select(*key, "side", "id", "sketch")
    links = posts.repartition(*key).sortWithinPartitions(*key).mapInArrow(grouped(key, _cell_links(sketch_floor(threshold)), LINK, {"sketch"}), "u long, v long")
    copies = sig.join(one.select("vh", F.col("id").alias("v")), "vh").where("id <> v").select(F.col("id").alias("u"), "v")
    return links.unionByName(copies).distinct()


def components(links: DataFrame) -> DataFrame:
    """``id, root``: the smallest id linked to each id that has a link. Rounds of contraction to the smallest neighbour.

    In each round every node moves to its smallest neighbour and links follow, until none is left between different nodes;
    then the moves are put together. Links and moves stay distributed and are written each round.
    """
    moves: list[DataFrame] = []
    edges = written(links.where("u <> v"))
    while edges.take(1):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        move = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("to")))
        moves.append(move)
        left, right = move.toDF("u", "a"), move.toDF("v", "b")
        old, edges = edges, written(edges.join(left, "u").join(right, "v").where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
        drop_written(old)
    if not moves:
        return links.select(F.col("u").alias("id"), F.col("v").alias("root")).limit(0)

    def follow(labels: DataFrame, move: DataFrame) -> DataFrame:
        step = move.toDF("root", "to")
        return labels.join(step, "root", "left").select("id", F.coalesce("to", "root").alias("root"))

    return written(reduce(follow, moves[1:], moves[0].toDF("id", "root")))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("sha"), b.column("at"), b.column("vh"), pa.array(pack(matrix(b.column("embedding"))), pa.binary())], ["sha", "at", "vh", "vector"])


def with_vectors(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """The vector of each content in ``placed`` (sha, at, vh and more), packed. Repeated rows of a content count once."""
    key = ["sha", "at", "vh"]
    packed = rows.select("sha", "at", F.xxhash64("embedding").alias("vh"), "embedding").mapInArrow(_packed, "sha string, at long, vh long, vector binary")
    return packed.join(placed, key).dropDuplicates(key)


def _columns(b: pa.RecordBatch, fixed: set[str]) -> dict[str, np.ndarray]:
    out = {}
    for name in b.schema.names:
        c = b.column(name)
        if pa.types.is_list(c.type):
            out[name] = matrix(c)
        elif name in fixed:
            out[name] = np.frombuffer(b"".join(c.to_pylist()), np.int8).reshape(len(c), -1)
        elif pa.types.is_binary(c.type):
            out[name] = np.array([*c.to_pylist(), None], dtype=object)[:-1]
        else:
            out[name] = c.to_numpy(zero_copy_only=False)
    return out


def grouped(key: list[str], work: Callable[[dict[str, np.ndarray]], list | None], schema: pa.Schema, fixed: set[str] = frozenset()) -> Callable:
    """Calls ``work`` for each run of equal keys in a partition sorted by ``key``; far cheaper for many small groups than a call of Spark's each.

    It gets columns as arrays (lists and binaries named in ``fixed``, of one length, as rows) and gives those of ``schema``.
    """

    def packed(done: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([d[i] for d in done]), f.type) for i, f in enumerate(schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[dict[str, np.ndarray]] = []
        whole = lambda: rest[0] if len(rest) == 1 else {c: np.concatenate([p[c] for p in rest]) for c in rest[0]}
        done: list[list] = []

        def close() -> None:
            if (got := work(whole())) is not None:
                done.append(got)
            rest.clear()

        for b in batches:
            if not len(b):
                continue
            cols = _columns(b, fixed)
            if rest and any(rest[0][k][0] != cols[k][0] for k in key):
                close()
            change = np.zeros(len(b) - 1, bool)
            for k in key:
                change |= cols[k][1:] != cols[k][:-1]
            cuts = [0, *(np.flatnonzero(change) + 1), len(b)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                rest.append({c: v[s:e] for c, v in cols.items()})
                if e < len(b):
                    close()
            if done:
                yield packed(done)
                done = []
        if rest:
            close()
        if done:
            yield packed(done)

    return run
