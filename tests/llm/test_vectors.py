"""Clusters and neighbours against brute force."""

from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark import schemas
from quillspark.llm import clusters, neighbours
from quillspark.llm import vectors as V

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "content_sha256 string, embedding array<float>, generated_at timestamp"


def sample(seed=1, groups=25, noise=0.35, hot=60):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        centre = rng.standard_normal(384)
        centre /= np.linalg.norm(centre)
        for _ in range(hot if g == 0 else int(rng.integers(1, 6))):
            x = centre + noise * rng.standard_normal(384) / np.sqrt(384)
            out.append(x / np.linalg.norm(x))
    # A chain whose ends aren't alike.
    a, b = np.eye(384)[0], np.eye(384)[1]
    out += [np.cos(t) * a + np.sin(t) * b for t in (0.0, 0.55, 1.1, 1.65)]
    out.append(out[5])
    return np.array(out).astype(np.float32)


def frame(spark, x):
    rows = [(f"c{i:04d}", v.tolist(), T0) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, SCHEMA).withColumns({"id": F.lit("x"), "sha": F.lit(1), "near": F.lit(2), "root": F.lit(3), "vh": F.lit(4)})


def groups_of(x, threshold=0.78):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    i, j = np.nonzero(s >= threshold)
    return V.local_roots(len(x), i, j), s


@pytest.mark.parametrize("block", [4096, 16])
def test_groups_equal_connected_components(spark, block):
    x = sample()
    want, _ = groups_of(x)
    got = {r["content_sha256"]: r for r in clusters.cluster_vectors(frame(spark, x), block=block).collect()}
    assert len(got) == len(x)
    assert {k: r["group_key"] for k, r in got.items()} == {f"c{i:04d}": f"c{r:04d}" for i, r in enumerate(want)}
    for r in got.values():
        assert r["similarity_to_anchor"] <= 1.0
        assert got[r["anchor_sha256"]]["cluster_id"] == r["cluster_id"]
    sizes = {}
    for r in got.values():
        sizes[r["cluster_id"]] = sizes.get(r["cluster_id"], 0) + 1
    assert all(sizes[r["cluster_id"]] == r["cluster_size"] for r in got.values())


def test_clusters_above_the_block_equal_those_within(spark):
    x = sample(6, groups=8, noise=0.53, hot=300)  # similarities in the hot group are on both sides of the threshold
    whole, *cut = [{r["content_sha256"]: r for r in clusters.cluster_vectors(frame(spark, x), block=b).collect()} for b in (4096, 128, 48)]
    what = lambda r: (r["anchor_sha256"], r["cluster_id"], r["cluster_size"], r["place"], r["pivot_sha256"], r["group_key"])
    for got in cut:
        assert {k: what(r) for k, r in got.items()} == {k: what(r) for k, r in whole.items()}
    assert len({r["cluster_id"] for r in whole.values() if r["group_size"] > 128}) > 1
    _, s = groups_of(x)
    at = lambda sha: int(sha[1:])
    pivots = {r["pivot_sha256"] for r in whole.values()}
    for k, r in whole.items():  # each member is similar to its pivot, and no pivot is closer; pivots aren't similar to each other
        assert k == r["pivot_sha256"] or s[at(k), at(r["pivot_sha256"])] >= 0.78
        assert k in pivots or s[at(k), at(r["pivot_sha256"])] >= max(s[at(k), at(p)] for p in pivots) - 1e-12
    assert all(s[at(p), at(q)] < 0.78 for p in pivots for q in pivots if p != q)


def test_places_in_stretches(spark):
    rng = np.random.default_rng(2)
    rows = [(i, f"c{i:03d}", i % 3, float(np.round(v, 1))) for i, v in enumerate(rng.random(300))]
    df = spark.createDataFrame(rows, "id long, sha string, to long, score double")
    want = {r[0]: p for t in range(3) for p, r in enumerate(sorted((r for r in rows if r[2] == t), key=lambda r: (-r[3], r[1])), 1)}
    for cell in (10, 50_000):
        assert {r["id"]: r["place"] for r in clusters.places(df, cell).collect()} == want


@pytest.mark.parametrize("block", [4096, 16])
def test_neighbours_equal_brute_force(spark, block):
    x = sample(2)
    _, s = groups_of(x)
    want = set()
    for i in range(len(x)):
        best = sorted((-round(s[i, j], 12), j) for j in range(len(x)) if j != i and s[i, j] >= 0.78)[:5]
        want |= {(f"c{i:04d}", f"c{j:04d}") for _, j in best}
    got = {(r["content_sha256"], r["neighbour_sha256"]) for r in neighbours.nearest(frame(spark, x), block=block).collect()}
    assert len(got & want) >= (0.999 if block == 4096 else 0.9) * len(want)
    assert block != 4096 or got == want


def test_neighbours_of_a_component_above_the_block_equal_brute_force(spark):
    x = sample(4, groups=3, noise=0.5, hot=1500)  # a component of some 1,500 vectors, each similar to about the whole group
    _, s = groups_of(x)
    want = set()
    for i in range(len(x)):
        best = sorted((-round(s[i, j], 12), j) for j in range(len(x)) if j != i and s[i, j] >= 0.78)[:5]
        want |= {(f"c{i:04d}", f"c{j:04d}", p) for p, (_, j) in enumerate(best, 1)}
    got = [(r["content_sha256"], r["neighbour_sha256"], r["place"]) for r in neighbours.nearest(frame(spark, x), block=200).collect()]
    assert len(got) == len(set(got))
    assert set(got) == want


def test_unusable_rows_and_newest(spark):
    v = np.eye(384, dtype=np.float32)
    later = datetime(2024, 2, 1, tzinfo=timezone.utc)
    rows = [
        ("a", v[0].tolist(), T0), ("a", v[1].tolist(), later), ("a", v[1].tolist(), later), ("b", v[1].tolist(), None), ("c", [0.0] * 384, T0), ("d", [1.0] * 100, T0), ("e", None, T0),
        ("f", [float("nan")] + [1.0] * 383, T0), ("g", [None] + [1.0] * 383, T0), (None, v[1].tolist(), T0), ("h", (v[1] * 1e30).tolist(), T0),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["content_sha256"]: r["group_key"] for r in clusters.cluster_vectors(df).collect()}
    assert got == {"a": "a", "b": "a", "h": "a"}
    near = {(r["content_sha256"], r["neighbour_sha256"]) for r in neighbours.nearest(df).collect()}
    assert near == {(p, q) for p in "abh" for q in "abh" if p != q}


def test_empty(spark):
    empty = spark.createDataFrame([], schemas.ARTICLE_EMBEDDINGS)
    assert clusters.cluster_vectors(empty).count() == 0
    assert neighbours.nearest(empty).count() == 0


def test_many_copies_are_one_entry(spark):
    v = np.ones(384, np.float32)
    df = spark.createDataFrame([(f"c{i:03d}", v.tolist(), T0) for i in range(300)], SCHEMA)
    got = clusters.cluster_vectors(df, block=64).collect()
    assert {r["group_key"] for r in got} == {"c000"}
    assert len(got) == 300
    assert neighbours.nearest(df).count() == 1500


def test_pivots_come_first_in_hash_order():
    near = np.zeros((4, 4), bool)
    near[0, 1] = near[1, 0] = near[1, 2] = near[2, 1] = True
    assert clusters.pivots_by_rounds(near, np.array([0, 1, 2, 3])).tolist() == [0, 0, 2, 3]
    assert clusters.pivots_by_rounds(near, np.array([2, 0, 1, 3])).tolist() == [1, 1, 1, 3]


def test_footrule():
    a = np.array([[1, 2, 3]])
    assert V.footrule(a, a)[0] == 0
    assert V.footrule(a, np.array([[2, 1, 3]]))[0] == 2
    assert V.footrule(a, np.array([[7, 8, 9]]))[0] == 12


def test_packing_is_lossless():
    x = np.random.default_rng(0).standard_normal(384).astype(np.float32)
    assert (V.unpack(V.pack(np.stack([x, -x]))) == np.stack([x, -x])).all()


def test_components_against_union_find(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2)) if a > b]
    got = {r["id"]: r["root"] for r in V.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    i, j = np.array(edges).T
    want = V.local_roots(300, i, j)
    assert got == {int(k): int(want[k]) for k in set(i) | set(j)}


def test_roots_of_dense_and_two_sided_links():
    rng = np.random.default_rng(8)
    for r, c in ((3, 2), (1500, 40), (40, 1500), (0, 4)):
        linked = rng.random((r, c)) < 2 / (r + c)
        i, j = np.nonzero(linked)
        want = V.local_roots(r + c, i, j + r)
        assert (V.two_sided_roots(linked) == want).all()
        whole = np.zeros((r + c, r + c), bool)
        whole[i, j + r] = whole[j + r, i] = True
        assert (V.dense_roots(whole) == want).all()


def test_two_level_pivots_against_all():
    x = V.unit(np.random.default_rng(9).standard_normal((900, 384))).astype(np.float32)
    few = V.Pivots(x[:12])
    want = np.argsort(-(x @ x[:12].T), axis=1, kind="stable")[:, :6]
    assert (few.nearest(x, 6) == want).all()
    many = V.Pivots(x[:400])
    got = many.nearest(x, 6)
    assert all(len(set(r)) == 6 for r in got)
    assert (got[:400, 0] == np.arange(400)).mean() > 0.99


def test_footrule_of_lists():
    rng = np.random.default_rng(10)
    a, b = (np.array([rng.permutation(20)[:6] for _ in range(n)]) for n in (30, 40))
    got = 6 * 7 - 2 * neighbours.shared_ranks(a, b).astype(int)
    assert all((got[i] == V.footrule(np.repeat(a[i : i + 1], 40, 0), b)).all() for i in range(30))


@pytest.mark.parametrize("check", [True, False])
def test_shortlists_by_footrule(check):
    # near copies in a dense group: the shortlist alone finds most, the check the rest
    rng = np.random.default_rng(11)
    centre = rng.standard_normal(384)
    x = np.concatenate([centre + 0.3 * rng.standard_normal(384) + 0.04 * rng.standard_normal((20, 384)) for _ in range(60)])
    x = V.unit(x)
    near = V.Pivots(x[::15].astype(np.float32)).nearest(x.astype(np.float32), 6)
    every = np.arange(len(x))
    i, j, _ = neighbours.nearest_of(x, near, every, every, 5, 0.78, 64, check)
    s = np.round(x @ x.T, 12)
    np.fill_diagonal(s, -2)
    want = {(a, b) for a in every for b in np.argsort(-s[a], kind="stable")[:5]}
    share = len(want & set(zip(i, j, strict=True))) / len(want)
    assert share > (0.997 if check else 0.8)
    if not check:
        k, l, _ = neighbours.nearest_of(x, near[rng.permutation(len(x))], every, every, 5, 0.78, 64, check)
        assert len(want & set(zip(k, l, strict=True))) < 0.6 * len(want)  # the order decides
