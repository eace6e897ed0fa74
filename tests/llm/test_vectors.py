"""The vector operators against brute force, with odd vectors, repeats, copies and clashing names."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagestream.llm import metric_join, zone_clusters
from pagestream.llm.common import ship, table

KIND = "vec_id long, embedding array<float>, label int, n_links string, cell int, node string"


@pytest.fixture(autouse=True)
def _shipped(spark):
    ship(spark)


def vectors_of(rng, many, dim=64, groups=(60, 20, 3), labels=3):
    """Isotropic vectors, groups of near copies, exact and scaled copies."""
    rows = [rng.normal(size=dim) for _ in range(many)]
    for size in groups:
        centre = rng.normal(size=dim)
        rows += [centre + 0.11 * rng.normal(size=dim) for _ in range(size)]
    rows += [rows[0]] * 4 + [rows[1] * 3, rows[2] * -1]
    rows = [np.asarray(r, np.float32).tolist() for r in rows]
    order = rng.permutation(len(rows))
    return [(int(i), rows[k], int(k) % labels) for i, k in enumerate(order)]


ODD = [
    (900, None, 1), (901, [], 1), (902, [0.0] * 64, 1), (903, [float("nan")] + [1.0] * 63, 1), (904, [float("inf")] + [1.0] * 63, 1),
    (905, [None] + [1.0] * 63, 1), (906, [1.0] * 64, None), (907, [1.0] * 64, None), (908, [1.0] * 3, 1), (909, [1.0] * 64, 1),
    (910, [2.0] * 64, 1), (910, [2.0] * 64, 1), (911, [-0.0, 1.0], 1), (912, [0.0, 1.0], 1), (None, [1.0] * 64, 1),
    (913, [3e38] * 64, 1), (914, [1e-42] * 64, 1),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], KIND)


def brute_links(rows, least):
    def good(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    units = []
    for _, v, _ in rows:
        wide = np.array(v, np.float64) if good(v) else None
        units.append(None if wide is None else wide / np.abs(wide).max())
    links = [set() for _ in rows]
    for i, (_, _, label) in enumerate(rows):
        for j in range(i):
            a, b = units[i], units[j]
            if label is None or rows[j][2] != label or a is None or b is None or len(a) != len(b):
                continue
            if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= least:
                links[i].add(j)
                links[j].add(i)
    out = []
    for i, (own, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        least_id = min(ids) if ids else None
        out.append((own, len(links[i]), least_id, None if own is None else own == least_id))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0.98, 0.7])
def test_links_equal_all_pairs(spark, rows, least):
    data = vectors_of(np.random.default_rng(3), 150) + ODD
    got = rows(metric_join.near_vectors(frame(spark, data), least))
    assert got == brute_links(data, least)


def test_links_with_many_pivots_and_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(metric_join, "COPY_WORK", 0)
    rng = np.random.default_rng(4)
    data = vectors_of(rng, 300, dim=4, groups=(200, 100), labels=1)
    placed = []
    place = metric_join._placed
    monkeypatch.setattr(metric_join, "_placed", lambda *a: placed.append(place(*a)) or placed[0])
    monkeypatch.setattr(metric_join, "BLOCK_ROWS", 16)
    got = rows(metric_join.near_vectors(frame(spark, data)))
    assert got == brute_links(data, 0.98)
    cells = {r["cell"] for r in placed[0].select("cell").distinct().collect()}
    assert len(cells) > 8 and placed[0].where("not home").count() > 0


def test_cells_meet_every_near_pair_once():
    rng = np.random.default_rng(5)
    for dim in (2, 3, 4):
        units = metric_join.unit(rng.normal(size=(400, dim)))
        cells = metric_join.Cells(metric_join.net(units, 0.8, 0.4), 0.2)
        home, guests, to = cells.place(units)
        own = [np.flatnonzero(home == c) for c in range(2 * len(cells.pivots))]
        met = np.zeros((400, 400), int)
        for members in own:
            met[np.ix_(members, members)] += 1
        for g, c in zip(guests, to):
            met[g, own[c]] += 1
            met[own[c], g] += 1
        near = 2 - 2 * units @ units.T <= 0.2**2
        np.fill_diagonal(near, False)
        assert near.sum() > 10 and (met[near] == 1).all() and met.max() == 1


def test_forest_reaches_what_links_reach():
    rng = random.Random(6)
    for _ in range(200):
        n, m = rng.randrange(1, 9), rng.randrange(1, 9)
        links = np.array([[rng.random() < 0.2 for _ in range(m)] for _ in range(n)])
        left, right = rng.sample(range(100), n), rng.sample(range(100, 200), m)
        rng.shuffle(right)
        roots, cols = metric_join.forest(links, np.array(left), np.array(right))
        for i in range(n):
            seen, todo = {("l", i)}, [("l", i)]
            while todo:
                side, k = todo.pop()
                new = {("r", j) for j in range(m) if links[k, j]} if side == "l" else {("l", j) for j in range(n) if links[j, k]}
                todo += new - seen
                seen |= new
            assert roots[i] == min(left[k] if side == "l" else right[k] for side, k in seen)
        for j in np.flatnonzero(links.any(axis=0)):
            assert cols[j] == roots[np.flatnonzero(links[:, j])[0]]


def test_links_of_an_empty_table_and_of_odd_vectors_alone(spark, rows):
    empty = frame(spark, [])
    assert metric_join.near_vectors(empty).count() == 0
    assert metric_join.near_vectors(empty).columns == ["vec_id", "n_links", "component_id", "kept"]
    assert rows(metric_join.near_vectors(frame(spark, ODD[:3]))) == [(900, 0, 900, True), (901, 0, 901, True), (902, 0, 902, True)]


def brute_clusters(rows, k=16, rounds=3, scale=64, dim=64):
    kept = [
        (i, [math.floor(scale * x) for x in map(float, np.array(v, np.float32))]) for i, v, _ in rows
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)
    ]
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    for step in range(rounds + 1):
        found = [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v in kept]
        if step < rounds:
            for n in range(len(centroids)):
                own = [v for (_, v), (_, m) in zip(kept, found) if m == n]
                if own:
                    centroids[n] = [sum(x) // len(own) for x in zip(*own)]
    cap = 2**63 - 1
    whole = min(cap, sum(d for d, _ in found))
    inertia = [min(cap, sum(d for d, m in found if m == n)) for n in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted([(i, n, min(cap, d), inertia[n], whole, digest[n]) for (i, _), (d, n) in zip(kept, found)], key=repr)


@pytest.mark.parametrize("kind", ["plain", "few", "huge", "ties"])
def test_clusters_equal_plain_rounds(spark, rows, monkeypatch, kind):
    monkeypatch.setattr(zone_clusters, "LEAST_ROWS", 4)
    monkeypatch.setattr(zone_clusters, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(8)
    data = vectors_of(rng, 120, groups=(90, 20))
    if kind == "few":
        data = data[:5]
    if kind == "ties":
        data = [(i, [float(x) for x in rng.integers(0, 2, 64) // (1 + i % 2)], 0) for i in range(60)] + [(i, [0.0] * 64, 0) for i in range(60, 120)]
    odd = ODD[:9] + ODD[11:13] if kind != "huge" else ODD
    got = rows(zone_clusters.cluster(frame(spark, data + odd)))
    assert got == brute_clusters(data + odd)


def test_clusters_of_an_empty_table(spark):
    empty = zone_clusters.cluster(frame(spark, ODD[:2] + ODD[3:6]))
    assert empty.count() == 0
    assert empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_curve_visits_neighbours():
    for dim, bits in ((2, 4), (3, 3), (5, 2)):
        cells = 2**bits
        grid = np.stack(np.meshgrid(*[np.arange(cells)] * dim, indexing="ij"), -1).reshape(-1, dim)
        places = zone_clusters.curve_places((grid + 0.5) / (cells / 2) - 1, 1.0, bits)
        assert len(set(places)) == len(grid)
        walk = grid[sorted(range(len(grid)), key=places.__getitem__)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_candidates_hold_every_nearest_centroid():
    rng, dropped = np.random.default_rng(9), 0
    for _ in range(300):
        dim = int(rng.integers(1, 5))
        corner, centroids = rng.integers(-20, 20, dim), rng.integers(-30, 30, (8, dim))
        box = corner + rng.integers(0, 6, (12, dim))
        some = zone_clusters.candidates(box.min(axis=0), box.max(axis=0), centroids)
        square = ((box[:, None] - centroids[None]) ** 2).sum(axis=2)
        number, least = zone_clusters.nearest(box, centroids, some)
        assert (number == square.argmin(axis=1)).all() and (least == square.min(axis=1)).all()
        dropped += 8 - len(some)
    assert dropped > 300


def test_boxes_spare_comparisons_where_vectors_lie_in_groups(spark):
    rng = np.random.default_rng(10)
    centres = rng.normal(size=(8, 64)) * 2
    data = [(i, (centres[i % 8] + 0.05 * rng.normal(size=64)).tolist(), 0) for i in range(8 * 640)]
    rng.shuffle(data)
    vectors = frame(spark, data)
    blocks = zone_clusters.zone_blocks(vectors, 64, 64, "vec_id", "embedding")
    centroids = [zone_clusters.quantized(c[None], 64)[0].tolist() for c in centres]
    found = zone_clusters.candidate_counts(blocks, centroids).agg(F.sum("vectors"), F.sum(F.col("vectors") * F.col("candidates"))).first()
    assert found[0] == len(data) and found[1] < 4 * len(data)
