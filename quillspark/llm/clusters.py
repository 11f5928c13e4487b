"""Similarity clusters of vectors with their anchors, by parallel pivot correlation clustering.

1. Signatures and posting lists bring together what may be similar (see ``vectors``); a link component holds every vector
   that a member of it is similar to.
2. In a component, vectors are ordered by a hash. Those that come before all their similar neighbours become pivots and
   absorb them. Rounds take the first vectors that are left: pivots among them absorb in the whole component, until none is
   left. So vectors are compared with pivots, not with each other. Members then move to the closest pivot, and each
   cluster gets a new anchor: the member that is most similar to all members together (its dot product with their sum).
3. A group is one cluster, or several whose members are similar: members of all but a component's largest cluster are
   compared, in double precision, with those of other clusters.

Pivots are those of the hash order, however many vectors a round takes, so a component may be worked at in any number of
pieces. One of up to ``block`` vectors is worked at in one; a larger one (a third of all rows may be near copies) is cut
into chunks, whose rounds, sums and comparisons run side by side, with the same result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm import vectors as V
from quillspark.session import drop_written, ship_package, written

#: A component up to this is worked at in one piece: it is compared with its pivots only, so this bounds memory, not work.
BLOCK = 8192
#: Vectors that a round within a block takes.
HEAD = 256
OUT = "sha string, pivot string, anchor string, similarity double, size long, place long, group_key string"
OUT_ARROW = pa.schema([("sha", pa.string()), ("pivot", pa.string()), ("anchor", pa.string()), ("similarity", pa.float64()), ("size", pa.int64()), ("place", pa.int64()), ("group_key", pa.string())])


def neighbours(x: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of ``x`` (of length one, double precision) reach ``threshold``; a row isn't its own neighbour."""
    near = np.empty((len(x), len(x)), bool)
    for at in range(0, len(x), 512):
        near[at : at + 512] = x[at : at + 512] @ x.T >= threshold
    near |= near.T  # the two halves may round differently
    np.fill_diagonal(near, False)
    return near


def pivots_by_rounds(near: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The pivot that absorbed each row. ``order`` is a permutation: earlier rows become pivots first."""
    n = len(order)
    pivot = np.full(n, -1)
    left = np.arange(n)
    at_order = np.argsort(order)
    while len(left):
        sub = near[np.ix_(left, left)]
        first = np.where(sub, order[left][None, :], n).min(axis=1)
        fresh = order[left] < first
        pivot[left[fresh]] = left[fresh]
        nearest = np.where(sub & fresh[None, :], order[left][None, :], n).min(axis=1)
        taken = ~fresh & (nearest < n)
        pivot[left[taken]] = at_order[nearest[taken]]
        left = left[~fresh & ~taken]
    return pivot


def hash_order(shas: np.ndarray) -> np.ndarray:
    """Each row's place by the hash of its content, ties by the content itself."""
    order = np.empty(len(shas), np.int64)
    order[np.lexsort((np.argsort(np.argsort(shas)), np.array([xxhash.xxh64_intdigest(s) for s in shas], np.uint64)))] = np.arange(len(shas))
    return order


def pivots_of(x: np.ndarray, order: np.ndarray, threshold: float, head: int = HEAD) -> np.ndarray:
    """Positions of the pivots among the rows of ``x``."""
    left, found = np.argsort(order), []
    while len(left):
        first = left[:head]
        fresh = first[np.unique(pivots_by_rounds(neighbours(x[first], threshold), np.arange(len(first))))]
        found.append(fresh)
        rest = left[head:]
        left = rest[_most(x[rest], x[fresh]) < threshold]
    return np.concatenate(found)


def _most(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The greatest similarity of each row of ``x`` to a row of ``p``."""
    return np.concatenate([np.zeros(0), *[(x[s : s + 2048] @ p.T).max(axis=1) for s in range(0, len(x), 2048)]])


def closest(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The closest of ``p`` to each row; of equally close ones the first."""
    return np.concatenate([np.zeros(0, int), *[(x[s : s + 2048] @ p.T).argmax(axis=1) for s in range(0, len(x), 2048)]])


def linked_clusters(x: np.ndarray, owner: np.ndarray, threshold: float) -> np.ndarray:
    """The smallest position in the group of each row: clusters (``owner``) with similar members are put together."""
    label = V._jump(np.minimum.reduceat(np.argsort(owner, kind="stable"), np.flatnonzero(np.r_[True, np.diff(np.sort(owner)) != 0]))[np.unique(owner, return_inverse=True)[1]])
    names, sizes = np.unique(label, return_counts=True)
    for name in names[np.argsort(sizes, kind="stable")][:-1]:  # the largest has been compared with all others then
        rows = np.flatnonzero(label == name) if (label == name).any() else np.zeros(0, int)
        other = np.flatnonzero(label != name)
        if not len(rows) or not len(other):
            continue
        touched = {name}
        for s in range(0, len(rows), 512):
            hit = (x[rows[s : s + 512]] @ x[other].T >= threshold).any(axis=0)
            touched |= set(label[other[hit]])
        if len(touched) > 1:
            label[np.isin(label, list(touched))] = max(touched, key=lambda t: (int((label == t).sum()), t))
    low = np.full(len(x), len(x))
    np.minimum.at(low, label, np.arange(len(x)))
    return low[label]


def describe(x: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor (a position), similarity to it, size and place of each row in the cluster ``owner`` names. Ties go to the earlier row."""
    order = np.argsort(owner, kind="stable")
    start = np.flatnonzero(np.r_[True, np.diff(owner[order]) != 0])
    cluster = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(order)]))
    total = np.round((x[order] * np.add.reduceat(x[order], start)[cluster]).sum(axis=1), 9)
    by_score = np.lexsort((order, -total, cluster))
    anchor, place, size = np.empty(len(x), int), np.empty(len(x), int), np.empty(len(x), int)
    place[order[by_score]] = np.arange(len(x)) - start[cluster] + 1
    anchor[order] = order[by_score][start][cluster]
    size[order] = np.diff(np.r_[start, len(order)])[cluster]
    return anchor, np.clip((x * x[anchor]).sum(axis=1), -1.0, 1.0), size, place


def cluster_block(threshold: float, head: int = HEAD) -> Callable[[dict[str, np.ndarray]], list[np.ndarray]]:
    """Clusters and groups of one component, whose rows come ordered by content."""

    def work(rows: dict[str, np.ndarray]) -> list[np.ndarray]:
        shas, x = rows["sha"], V.unit(V.unpack(rows["vector"]))
        pivots = np.sort(pivots_of(x, hash_order(shas), threshold, head))
        owner = pivots[closest(x, x[pivots])]
        owner[pivots] = pivots  # also where a copy is as close
        group = linked_clusters(x, owner, threshold) if len(pivots) > 1 else np.zeros(len(x), int)
        anchor, similarity, size, place = describe(x, owner)
        return [shas, shas[owner], shas[anchor], similarity, size, place, shas[group]]

    return work


def cross_links(threshold: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Links between similar rows of different clusters (``to``) on the two sides of a piece, at most one a row and cluster."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        x, side, to = V.unit(V.unpack(rows["vector"].to_list())), rows["side"].to_numpy(), rows["to"].to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        found: set[tuple[int, int]] = set()
        for at in range(0, len(left), 512):
            a, b = np.nonzero(x[left[at : at + 512]] @ x[right].T >= threshold)
            u, v = to[left[at : at + 512][a]], to[right[b]]
            found |= set(map(tuple, np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)], axis=1)[u != v], axis=0).tolist()))
        return pd.DataFrame(sorted(found), columns=["u", "v"], dtype="int64")

    return work


def _take_prefix(threshold: float) -> Callable:
    """The pivots of the first rows of a component that are left."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        fresh = pivots_of(V.unit(V.unpack(rows["vector"].to_list())), hash_order(rows["sha"].to_numpy()), threshold)
        return rows.iloc[fresh][["root", "id", "vector"]]

    return work


def _pivots_by_prefix(vecs: DataFrame, threshold: float, block: int) -> DataFrame:
    """``id`` of the pivots of components larger than a block.

    In rounds, the first block of a component by the hash order gives its pivots, and what they absorb drops out all over the
    component, until nothing is left.
    """

    def hashes(batches):
        for b in batches:
            yield b.assign(h=[xxhash.xxh64_intdigest(x) - 2**63 for x in b["sha"]])

    left = written(vecs.select("id", "sha", "root", "chunk", "vector").mapInPandas(hashes, "id long, sha string, root long, chunk long, vector binary, h long"))

    def rest(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        if len(rows) and len(pivots):
            far = _most(V.unit(V.unpack(rows["vector"].to_list())), V.unit(V.unpack(pivots["pv"].to_list()))) < threshold
            rows = rows[far & ~rows["id"].isin(pivots["to"]).to_numpy()]
        return rows

    found = None
    while left.take(1):
        # Each chunk gives its first block, of which the component's first block is taken: no component is sorted in one task.
        by = lambda *part: F.row_number().over(Window.partitionBy(*part).orderBy("h", "sha"))
        some = left.select("root", "chunk", "id", "h", "sha").withColumn("i", by("root", "chunk")).where(F.col("i") <= block)
        prefix = left.join(some.withColumn("i", by("root")).where(F.col("i") <= block).select("id"), "id", "left_semi")
        fresh = written(prefix.groupBy("root").applyInPandas(_take_prefix(threshold), "root long, id long, vector binary"))
        found = fresh.select("id") if found is None else found.unionByName(fresh.select("id"))
        parts = left.select("root", "chunk").distinct().join(fresh, "root").select(F.col("root").alias("of_root"), F.col("chunk").alias("of_chunk"), F.col("id").alias("to"), F.col("vector").alias("pv"))
        old, left = left, written(left.groupBy("root", "chunk").cogroup(written(parts).groupBy("of_root", "of_chunk")).applyInPandas(rest, left.schema))
        drop_written(old)
    return found


def places(score: DataFrame, cell: int = 50_000) -> DataFrame:
    """``id, place``: the order of each member (``id, sha, to, score``) in its cluster by score, the greatest first, equal ones by the smaller content.

    Scores of a large cluster are cut into stretches; places within these are added to prefix sums of their counts, so no
    cluster is sorted in one task.
    """
    s = score.select("id", "sha", "to", "score")
    of = s.groupBy("to").agg(F.min("score").alias("low"), F.max("score").alias("high"), F.ceil(F.count("*") / F.lit(cell)).alias("k"))
    at = F.when((F.col("k") > 1) & (F.col("high") > F.col("low")), F.floor((F.col("high") - F.col("score")) / (F.col("high") - F.col("low")) * F.col("k") * 16)).otherwise(0)
    s = s.join(of, "to").select("id", "sha", "to", "score", at.cast("long").alias("c"))
    counts = s.groupBy("to", "c").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("to").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("to", "c", before.alias("before"))
    i = F.row_number().over(Window.partitionBy("to", "c").orderBy(F.col("score").desc(), "sha"))
    return s.withColumn("i", i).join(counts, ["to", "c"]).select("id", (F.col("before") + F.col("i")).cast("long").alias("place"))


def _linked_large(placed: DataFrame, threshold: float, block: int) -> DataFrame:
    """``to, part``: the group (an id) of each cluster; ``placed`` has ``id, root, chunk, to, vector``.

    Members outside a component's largest cluster are cut into parts of a block, and each part is compared with each chunk
    of the component. Only clusters travel from there on.
    """
    sizes = placed.groupBy("root", "to").count()
    largest = sizes.groupBy("root").agg(F.max(F.struct("count", "to")).alias("m"), F.sum("count").alias("n"), F.count("*").alias("k")).where("k > 1")
    main = largest.select("root", F.col("m.to").alias("main"), F.ceil((F.col("n") - F.col("m.count")) / F.lit(block)).alias("parts"))
    clusters = sizes.select("to")
    with_main = written(placed.join(main, "root"))
    if not with_main.take(1):
        return clusters.select("to", F.col("to").alias("part"))
    chunks = with_main.select("root", "chunk").distinct()
    rest = with_main.where("to <> main").drop("chunk").withColumn("piece", F.pmod(F.xxhash64("id", F.lit(1)), "parts"))
    cols = ["root", "chunk", "piece", "to", "vector", "side"]
    left = rest.join(chunks, "root").withColumn("side", F.lit(0)).select(cols)
    right = with_main.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumn("side", F.lit(1)).select(cols)
    links = left.unionByName(right).groupBy("root", "chunk", "piece").applyInPandas(cross_links(threshold), "u long, v long").distinct()
    found = V.components(links).select(F.col("id").alias("to"), F.col("root").alias("part"))
    return clusters.join(found, "to", "left").select("to", F.coalesce("part", "to").alias("part"))


def _cluster_large(vecs: DataFrame, threshold: float, block: int) -> DataFrame:
    """Clusters and groups of components larger than a block; ``vecs`` has ``id, sha, root, n, vector``."""
    vecs = written(vecs.withColumn("chunk", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / F.lit(block)))))
    pivots = _pivots_by_prefix(vecs, threshold, block)
    pivots = vecs.join(pivots, "id", "left_semi").select("root", F.col("id").alias("to"), F.col("sha").alias("psha"), F.col("vector").alias("pv"))
    own = vecs.select("id", "sha", "root", "chunk", "vector")
    chunks = written(own.select("root", "chunk").distinct().join(pivots, "root").select(F.col("root").alias("of_root"), F.col("chunk").alias("of_chunk"), "to", "psha", "pv"))

    def move(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return rows.assign(to=0)
        pivots = pivots.sort_values("psha", ignore_index=True)  # of equally close ones the smaller content, as in a block
        at = closest(V.unit(V.unpack(rows["vector"].to_list())), V.unit(V.unpack(pivots["pv"].to_list())))
        to = pivots["to"].to_numpy()
        return rows.assign(to=np.where(rows["id"].isin(to), rows["id"], to[at]))

    placed = written(own.groupBy("root", "chunk").cogroup(chunks.groupBy("of_root", "of_chunk")).applyInPandas(move, "id long, sha string, root long, chunk long, vector binary, to long"))
    groups = written(placed.select("id", "sha", "to").join(_linked_large(placed, threshold, block), "to"))
    keys = groups.groupBy("part").agg(F.min("sha").alias("group_key"))
    groups = groups.join(keys, "part").select("id", "group_key")

    def sums(batches):
        for b in batches:
            x = V.unit(V.unpack(b["vector"].to_list()))
            for o in np.unique(b["to"]):
                yield pd.DataFrame({"to": [o], "total": [x[(b["to"] == o).to_numpy()].sum(axis=0)]})

    total = placed.select("to", "vector").mapInPandas(sums, "to long, total array<double>").select("to", F.posexplode("total").alias("d", "t")).groupBy("to", "d").agg(F.sum("t").alias("t"))
    total = total.groupBy("to").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "t"))), lambda s: s["t"]).alias("total"))

    def scored(batches):
        for b in batches:
            x = V.unit(V.unpack(b["vector"].to_list()))
            yield pd.DataFrame({"id": b["id"], "sha": b["sha"], "to": b["to"], "vector": b["vector"], "score": np.round((x * np.stack(b["total"].to_list())).sum(axis=1), 9)})

    score = written(placed.select("id", "sha", "to", "vector").join(total, "to").mapInPandas(scored, "id long, sha string, to long, vector binary, score double"))
    anchors = score.groupBy("to").agg(F.min_by(F.struct(F.col("sha").alias("anchor"), F.col("vector").alias("av")), F.struct(-F.col("score"), F.col("sha"))).alias("m"), F.count("*").alias("size")).select("to", "m.*", "size")

    def similar(batches):
        for b in batches:
            x, a = V.unit(V.unpack(b["vector"].to_list())), V.unit(V.unpack(b["av"].to_list()))
            yield b.drop(columns=["vector", "av"]).assign(similarity=np.clip((x * a).sum(axis=1), -1.0, 1.0))

    done = score.join(anchors, "to").select("to", "id", "sha", "score", "vector", "anchor", "av", "size").mapInPandas(similar, "to long, id long, sha string, score double, anchor string, size long, similarity double")
    pivot_shas = pivots.select("to", F.col("psha").alias("pivot"))
    return done.join(pivot_shas, "to").join(places(score), "id").join(groups, "id").select("sha", "pivot", "anchor", "similarity", "size", "place", "group_key")


def cluster_vectors(embeddings: DataFrame, threshold: float = 0.78, lists: int = 6, block: int = BLOCK) -> DataFrame:
    """One row per content: ``content_sha256, cluster_id, cluster_size, anchor_sha256, similarity_to_anchor, place, pivot_sha256, group_key, group_size``.

    Usable vectors have exactly 384 finite numbers, not all zero; each content counts with its newest usable row, repeated
    rows once. ``anchor`` is the most typical member, ``place`` a member's order by typicality, and ``pivot`` the member
    that absorbed the cluster, to which every member is similar. ``group_key`` is the smallest content of all that are linked by
    similarity, directly or through others. A content like no other is a cluster of its own. Contents without a usable
    vector don't come out; an empty table gives no rows. Extra columns are ignored.
    """
    ship_package(embeddings.sparkSession)
    rows = V.usable_rows(embeddings)
    sig = V.signatures(rows, lists)
    roots = V.components(V.candidate_links(sig, threshold))
    linked = sig.join(roots, "id")
    sizes = linked.groupBy("root").agg(F.count("*").alias("n"))
    placed = written(linked.join(sizes, "root").select("sha", "at", "vh", "id", "root", "n"))
    single = sig.join(roots, "id", "left_anti").select("sha", F.col("sha").alias("pivot"), F.col("sha").alias("anchor"), F.lit(1.0).alias("similarity"), F.lit(1).cast("long").alias("size"), F.lit(1).cast("long").alias("place"), F.col("sha").alias("group_key"))
    small = V.with_vectors(rows, placed.where(F.col("n") <= block)).select("root", "sha", "vector").repartition("root").sortWithinPartitions("root", "sha")
    out = single.unionByName(small.mapInArrow(V.grouped(["root"], cluster_block(threshold), OUT_ARROW), OUT))
    if placed.where(F.col("n") > block).take(1):
        large = V.with_vectors(rows, placed.where(F.col("n") > block)).select("id", "sha", "root", "n", "vector")
        out = out.unionByName(_cluster_large(large, threshold, block))
    out = written(out)
    groups = out.groupBy("group_key").agg(F.count("*").alias("group_size"))
    return out.join(groups, "group_key").select(
        F.col("sha").alias("content_sha256"),
        F.concat(F.lit("group-"), F.substring(F.sha2("anchor", 256), 1, 16)).alias("cluster_id"),
        F.col("size").alias("cluster_size"),
        F.col("anchor").alias("anchor_sha256"),
        F.col("similarity").alias("similarity_to_anchor"),
        "place",
        F.col("pivot").alias("pivot_sha256"),
        "group_key",
        "group_size",
    )
