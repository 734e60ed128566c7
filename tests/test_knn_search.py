"""The two searches beside the grid: best first over a tree of cells, and random projections."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from carelens.operators import knn, knn_index


def _points(spark, rec, don):
    """Points from z values (NaN: missing) of both sides; x equals z."""
    nf = don.shape[1]
    zs = [f"z{i}" for i in range(nf)]

    def side(values, ids, name, extra):
        pat = (~np.isnan(values)) @ (1 << np.arange(nf))
        rows = [(int(i), int(p), *(None if np.isnan(v) else float(v) for v in r)) for i, p, r in zip(ids, pat, values, strict=True)]
        df = spark.createDataFrame(rows, f"{name} long, pat int, " + ", ".join(f"{z} double" for z in zs))
        return df.select("*", *(F.col(z).alias(f"x{i}") for i, z in enumerate(zs))) if extra else df
    span = float(np.nanmax(np.vstack((rec, don))) - np.nanmin(np.vstack((rec, don))))
    donors = side(don, range(len(don)), "id", True).checkpoint()
    receivers = side(rec, range(10 ** 6, 10 ** 6 + len(rec)), "rkey", False).checkpoint()
    return knn.Points(donors, receivers, donors, [f"f{i}" for i in range(nf)], [0.0] * nf, span, F.lit(False))


def _brute(rec, don, k=5):
    nf, out = don.shape[1], {}
    for r, row in enumerate(rec):
        shared = ~np.isnan(row) & ~np.isnan(don)
        with np.errstate(divide="ignore", invalid="ignore"):
            d = np.round(np.sqrt(nf / shared.sum(1) * np.where(shared, (row - don) ** 2, 0).sum(1)), 9)
        for f in np.flatnonzero(np.isnan(row)):
            ok = np.flatnonzero(~np.isnan(don[:, f]) & (shared.sum(1) > 0))
            top = ok[np.lexsort((ok, d[ok]))[:k]]
            out[10 ** 6 + r, int(f)] = [(int(i), float(d[i])) for i in top]
    return out


def _far(n=20_000, m=40, seed=3):
    rng = np.random.default_rng(seed)
    don = rng.normal(size=(n, 3))
    don[:, 1] = rng.integers(-3, 4, n)              # many ties in one coordinate
    don[::7, 0] = np.nan
    rec = rng.normal(size=(m, 3))
    rec[:, 2] = np.nan
    rec[: m // 2, 0] = 1e6 + rng.normal(size=m // 2)
    rec[m // 2:, 1] = -1e6
    rec[0] = (np.nan, 1e6, np.nan)
    return rec, don


def test_far_outliers_are_found_without_comparing_layers(spark):
    rec, don = _far()
    pts = _points(spark, rec, don)
    got = {}
    for r in knn.neighbours(pts).orderBy("rn").collect():
        got.setdefault((r.rkey, r.feature), []).append((r.donor, round(r.dist, 9)))
    want = _brute(rec, don)
    assert got.keys() == want.keys()
    for key, near in want.items():
        assert np.allclose([d for _, d in got[key]], [d for _, d in near], rtol=1e-12, atol=2e-9), key

    layers = knn._layers(pts.receivers, pts.donors, knn._pattern_counts(pts.receivers), knn._pattern_counts(pts.donors), 3)
    donors = knn_index.once_per_place(layers.donors, 3, 5).withColumn("cell", knn_index.layer_cell(3, 1 / knn_index.STEP)).checkpoint()
    tree = knn_index.cell_tree(donors, 3, pts.span, 1 / knn_index.STEP)
    assert tree[-1].groupBy("layer").count().agg(F.max("count")).first()[0] <= 4 and len(tree) >= 7
    pairs = knn_index.leaf_cells(layers.receivers, tree, 3, 5).agg(F.sum("n")).first()[0]
    assert pairs < 50 * 5 * len(rec)                # distances of 10^6 are told apart to 1e-9; a layer has 2,857 or 17,143 donors


def test_sparse_corners_match_brute_force(spark):
    rng = np.random.default_rng(8)
    don = np.vstack((rng.normal(size=(300, 4)), rng.normal(size=(30, 4)) * 40, [[9.0, 9.0, 9.0, np.nan]] * 3))
    don[rng.random(don.shape) < .2] = np.nan
    don = don[(~np.isnan(don)).any(1)]
    rec = np.vstack((rng.normal(size=(30, 4)) * 30, rng.normal(size=(20, 4))))
    rec[rng.random(rec.shape) < .4] = np.nan
    rec = rec[np.isnan(rec).any(1) & (~np.isnan(rec)).any(1)]
    want = _brute(rec, don)
    for width in (1.0, 0.05):
        got = {}
        for r in knn.neighbours(_points(spark, rec, don), cell_width=width).orderBy("rn").collect():
            got.setdefault((r.rkey, r.feature), []).append((r.donor, round(r.dist, 9)))
        assert got == want


def test_random_projections(spark):
    rng = np.random.default_rng(4)
    don = rng.normal(size=(6000, 5))
    don[::9, 3] = np.nan
    rec = rng.normal(size=(150, 5))
    rec[:, 0] = np.nan
    rec[::4, 2] = np.nan
    rec[:3, 1] = 500.0                              # nobody shares a key: searched exactly
    pts = _points(spark, rec, don)
    want = _brute(rec, don)
    rows = knn.neighbours(pts, method="lsh").collect()
    got = {}
    for r in rows:
        got.setdefault((r.rkey, r.feature), set()).add(round(r.dist, 9))
    assert got.keys() == want.keys()
    exact = {(r.rkey, r.feature, r.donor): r.dist for r in knn.neighbours(pts).collect()}
    assert all(abs(exact.get((r.rkey, r.feature, r.donor), r.dist) - r.dist) < 1e-12 for r in rows)
    hits = sum(d in got[key] for key, near in want.items() for _, d in near)
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert all(d in got[10 ** 6 + i, 0] for i in range(3) for _, d in want[10 ** 6 + i, 0])


def test_keys_of_large_layers_hold_few_donors(spark):
    rng = np.random.default_rng(11)
    don = rng.normal(size=(30_000, 4))
    don[:, 3] = rng.integers(0, 3, 30_000)
    rec = rng.normal(size=(60, 4))
    rec[:, 3] = rng.integers(0, 3, 60)
    rec[:, 0] = np.nan
    pts = _points(spark, rec, don)
    layers = knn._layers(pts.receivers, pts.donors, knn._pattern_counts(pts.receivers), knn._pattern_counts(pts.donors), 4)
    held = knn_index.lsh_keys(layers.donors, 4, layers.sizes).groupBy("layer", "cell").count()
    met = held.agg((F.sum(F.col("count") * F.col("count")) / F.sum("count")).alias("n")).first().n
    assert met < 0.12 * len(don)                    # three wide buckets a key: 0.3 and more
    want, got = _brute(rec, don), {}
    for r in knn.neighbours(pts, method="lsh").collect():
        got.setdefault((r.rkey, r.feature), set()).add(r.donor)
    assert sum(d in got[key] for key, near in want.items() for d, _ in near) >= 0.9 * sum(map(len, want.values()))
    assert knn_index.lsh_grain(8192) == (3, 3.0) and knn_index.lsh_grain(50_000_000)[0] > knn_index.lsh_grain(500_000)[0] > knn_index.lsh_grain(10_000)[0]


def test_methods_are_checked(spark):
    pts = _points(spark, np.array([[np.nan, 1.0]]), np.array([[1.0, 2.0]]))
    with pytest.raises(ValueError, match="unknown method"):
        knn.neighbours(pts, method="guess")
    assert [(r.donor, r.value) for r in knn.neighbours(pts).collect()] == [(0, 1.0)]
    none = _points(spark, np.array([[np.nan, 1.0]]), np.array([[1.0, np.nan]]))
    assert knn.neighbours(none).collect() == []


def test_donors_of_a_place_are_searched_once(spark):
    rng = np.random.default_rng(21)
    don = rng.integers(0, 4, (3000, 4)).astype(float)
    don[:, 0] = rng.normal(size=3000)               # filled in: a value of its own per donor
    don[::5, 3] = np.nan
    rec = rng.integers(0, 4, (40, 4)).astype(float)
    rec[:, 0] = np.nan
    rec[::4, 3] = np.nan
    rec[-1] = (np.nan, 900.0, 1.0, np.nan)          # left to the tree
    pts, want = _points(spark, rec, don), _brute(rec, don)
    _, places = knn._layered(pts, 5)
    per_layer = {r.layer: r.n for r in places.groupBy("layer").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert max(per_layer.values()) <= 4 ** 3 * 5 and sum(per_layer.values()) < 900   # donors in layers: several thousand
    assert places.filter("n > 5 or n != size(members)").isEmpty()
    for method in ("exact", "lsh"):
        got = {}
        for r in knn.neighbours(pts, method=method).orderBy("rn").collect():
            assert r.value == don[r.donor, r.feature]
            got.setdefault((r.rkey, r.feature), []).append((r.donor, round(r.dist, 9)))
        assert got == want                          # ties by the smallest ids, as among single donors


def test_a_row_that_comes_twice_is_one_donor(spark):
    don = np.array([[1.0, 0.0], [1.0, 0.0], [2.0, 0.0], [3.0, 1.0], [4.0, 2.0], [5.0, 3.0], [6.0, 4.0]])
    pts = _points(spark, np.array([[np.nan, 0.0], [np.nan, 60.0]]), don)
    twice = pts.donors.unionByName(pts.donors).checkpoint()
    pts = knn.Points(pts.clean, pts.receivers, twice, pts.features, pts.means, pts.span, pts.any_missing)
    for method in ("exact", "lsh"):
        near = [r.donor for r in knn.neighbours(pts, method=method).orderBy("rkey", "rn").collect()]
        assert near == [0, 1, 2, 3, 4, 6, 5, 4, 3, 0]   # the second is left to the tree


def test_both_searches_read_the_same_places(spark, monkeypatch):
    made, places = [], knn_index.places
    monkeypatch.setattr(knn_index, "places", lambda *a: made.append(a) or places(*a))
    pts = _points(spark, np.array([[np.nan, 0.2], [np.nan, 7.0]]), np.array([[float(i), i / 3] for i in range(12)]))
    exact, lsh = ([(r.rkey, r.donor) for r in knn.neighbours(pts, method=m).orderBy("rkey", "rn").collect()] for m in ("exact", "lsh"))
    assert exact == lsh and len(exact) == 10 and len(made) == 1
