"""Exact k-nearest-neighbour imputation (service variant).

Semantics
---------
Features are z-scored with the mean and population deviation of the present
values. For a row missing feature ``f``, donors are the rows where ``f`` is
present. Distance over the coordinates present in both rows:
``sqrt(n_features / n_shared * sum(diff^2))``; a donor sharing no coordinate is
not comparable. The 5 nearest comparable donors, ordered by (distance rounded to
9 places, donor id), are averaged with weights 1/distance; donors at distance 0
take all the weight. With no comparable donor the feature's mean is used.
Averages are taken on the original scale (the z-score is linear, so this equals
averaging z-scores and transforming back).

Execution (exact, no pair is materialised as a row, nothing unbounded broadcast)
-------------------------------------------------------------------------------
1. Receivers are the distinct feature vectors with a missing feature (keyed by
   their smallest row id). Donors keep at most ``k`` rows per distinct vector,
   the smallest ids: equal vectors are equally far from every receiver, so no
   other row of the vector can enter a top ``k`` ordered by (distance, id). A
   vector held by a third of all rows therefore costs ``k`` donors.
2. Layers: a (receiver null pattern, donor null pattern) pair fixes the shared
   coordinates ``S``; inside a layer the distance is Euclidean over ``S``. The
   layer table has at most (observed patterns)^2 rows. Donors that agree in all
   of ``S`` are equally far from every receiver of the layer: they are searched as
   one *place*, which keeps the donors with the ``k`` smallest ids. All receivers of
   a layer fill in the same features, so a place is measured once for all of them.
   A place is a single donor where values are continuous.
3. Grid: in each layer, points fall into cells of width ``cell_width`` (z units)
   over ``S``. Phase 1 searches the receiver's own cell and, when it holds at
   least ``k`` donors, takes the k-th distance as the search radius ``U``.
   Phase 2 searches the neighbouring cells whose box lies within ``U`` (at most
   one cell to each side per coordinate, since ``U`` is capped at the width).
   Every place closer than ``U`` lies in a searched cell, so each layer's top
   ``k`` is exact; the global top ``k`` is the merge of the layers' top ``k``, and
   the donors of these places hold the ``k`` nearest donors.
4. Receivers without a usable radius in some layer (fewer than ``k`` donors in
   the own cell, or ``U`` wider than a cell) are searched best first over a tree of
   the donors' cells (``knn_index.best_first``), which is exact too.
5. Searching a cell is one ``cogroup`` + ``applyInPandas`` task per chunk pair:
   cells with many points are cut into receiver and donor chunks, so no task
   holds more than ``chunk_rows`` points of either side; each task returns at
   most ``k`` places per receiver.
The work is the sum over cells of receivers x places in the neighbourhood,
instead of receivers x donors over the whole table.

``method="lsh"`` replaces steps 3 and 4 by random projections (approximate).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelens import config as C
from carelens.operators import knn_index
from carelens.session import ensure_checkpoint_dir, ship_package

SUB_BATCH = 512
CELL_WIDTH = 1.0      # grid cell width, in standard deviations
CHUNK_ROWS = 1024     # points of one side per grid task


def _stats(df: DataFrame, features: list[str], any_missing):
    """Means, population deviations, the widest range in deviations, and the count
    of incomplete rows, in one aggregate."""
    aggs = [F.count_if(any_missing).alias("n_incomplete")]
    for i, f in enumerate(features):
        c = F.col(f).cast("double")
        aggs += [F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}"), (F.max(c) - F.min(c)).alias(f"r{i}")]
    row = df.agg(*aggs).first()  # one row of statistics
    means = [row[f"m{i}"] for i in range(len(features))]
    sds = [row[f"s{i}"] if row[f"s{i}"] not in (None, 0.0) else 1.0 for i in range(len(features))]
    span = max((row[f"r{i}"] or 0.0) / sds[i] for i in range(len(features)))
    return means, sds, span, row["n_incomplete"]


# Candidates are cut with the fast (matrix-product) squared distances, each with a
# bound on its rounding error that grows with the points' norms, then re-measured
# exactly, so no true neighbour is lost however far out the points lie.
EXPANSION_ERROR = 64 * np.finfo(float).eps
# Distances are compared to 9 places.
ROUNDING = 1e-9

CAND_SCHEMA = T.StructType([T.StructField("rkey", T.LongType()), T.StructField("feature", T.IntegerType()),
                            T.StructField("donor", T.LongType()), T.StructField("dist", T.DoubleType()),
                            T.StructField("value", T.DoubleType())])
PLACE_SCHEMA = T.StructType([T.StructField("rkey", T.LongType()), T.StructField("layer", T.IntegerType()),
                             T.StructField("pid", T.LongType()), T.StructField("id", T.LongType()),
                             T.StructField("n", T.IntegerType()), T.StructField("dist", T.DoubleType())])


def _nearest(shared: dict[int, int], nf: int, k: int):
    """Task kernel: the k nearest places of one chunk of a layer for each of its receivers.
    ``shared``: the coordinates that a layer's points share, by layer."""
    zs = [f"z{i}" for i in range(nf)]

    def run(key, rec: pd.DataFrame, don: pd.DataFrame) -> pd.DataFrame:
        if rec.empty or don.empty:
            return pd.DataFrame({f.name: [] for f in PLACE_SCHEMA.fields})
        layer = int(key[0])
        coords = [i for i in range(nf) if shared[layer] >> i & 1]
        scale = nf / len(coords)
        # Other coordinates count as 0 on both sides.
        dz, rz_all = np.zeros((len(don), nf)), np.zeros((len(rec), nf))
        dz[:, coords] = don[[zs[i] for i in coords]].to_numpy(dtype=float)
        rz_all[:, coords] = rec[[zs[i] for i in coords]].to_numpy(dtype=float)
        dsq = (dz * dz).sum(axis=1)
        ids, pids = don["id"].to_numpy(), don["pid"].to_numpy()
        kk = min(k, len(don))
        found = []
        for s in range(0, len(rec), SUB_BATCH):
            rz = rz_all[s:s + SUB_BATCH]
            norms = (rz * rz).sum(axis=1)[:, None] + dsq[None, :]
            low = norms - 2.0 * (rz @ dz.T)
            error = EXPANSION_ERROR * norms
            kth = np.partition(low + error, kk - 1, axis=1)[:, kk - 1]
            low -= error
            reach = (np.sqrt(scale * np.maximum(kth, 0.0)) + ROUNDING) ** 2 / scale
            ri, di = np.nonzero(low <= (reach * (1 + EXPANSION_ERROR))[:, None])
            diff = rz[ri] - dz[di]
            d = np.sqrt(scale * (diff * diff).sum(axis=1))
            order = np.lexsort((pids[di], ids[di], np.round(d, 9), ri))
            r_sorted = ri[order]
            first = np.r_[True, r_sorted[1:] != r_sorted[:-1]]
            start_idx = np.maximum.accumulate(np.where(first, np.arange(r_sorted.size), 0))
            keep = order[(np.arange(r_sorted.size) - start_idx) < k]
            found.append((s + ri[keep], di[keep], d[keep]))
        r, d, dist = (np.concatenate(c) for c in zip(*found, strict=True))
        return pd.DataFrame({"rkey": rec["rkey"].to_numpy()[r], "layer": np.full(r.size, layer, dtype=np.int32), "pid": pids[d],
                             "id": ids[d], "n": don["n"].to_numpy()[d], "dist": dist})

    return run


def _cell_search(rec: DataFrame, don: DataFrame, cell_cols: list[str], shared: dict[int, int], nf: int, k: int,
                 chunk_rows: int) -> DataFrame:
    """Each receiver against (at least) the places of its own (layer, cell).

    Cells holding at most ``chunk_rows`` points per side are packed by hash into
    buckets of one layer, about ``chunk_rows`` points of its larger side each, so a
    task compares a receiver with its own cell and some other cells (real places
    at real distances: extra candidates, never missing ones). Bigger cells are cut into receiver x donor
    chunk pairs of at most ``chunk_rows`` points each. A task returns at most k
    places per receiver; a (receiver, place) pair may be seen twice, so callers
    count places once."""
    keys = ["layer", *cell_cols]
    zs = [f"z{i}" for i in range(nf)]
    sizes = (rec.groupBy(*keys).agg(F.count(F.lit(1)).alias("nr"))
                .join(don.groupBy(*keys).agg(F.count(F.lit(1)).alias("nd")), on=keys, how="inner")
                .withColumn("big", (F.col("nr") > chunk_rows) | (F.col("nd") > chunk_rows))).checkpoint()
    # One row per layer.
    packed = sizes.filter(~F.col("big")).groupBy("layer").agg(F.greatest(F.sum("nr"), F.sum("nd")).alias("n")).collect()
    buckets = F.create_map(*(F.lit(v) for r in packed for v in (r.layer, math.ceil(r.n / chunk_rows)))) if packed else F.lit(None)
    cell_hash = F.xxhash64(*[F.col(c) for c in cell_cols])
    sizes = (sizes.withColumn("gid", F.when(F.col("big"), cell_hash).otherwise(F.pmod(cell_hash, buckets[F.col("layer")])) if packed else cell_hash)
                  .withColumn("q", F.when(F.col("big"), F.ceil(F.col("nr") / chunk_rows)).otherwise(1).cast("int"))
                  .withColumn("p", F.when(F.col("big"), F.ceil(F.col("nd") / chunk_rows)).otherwise(1).cast("int"))
                  .drop("nr", "nd"))
    gkeys = ["layer", "big", "gid", "rc", "dc"]

    def chunks(side: DataFrame, own: str, own_n: str, other: str, other_n: str, point: str, cols: list[str]) -> DataFrame:
        # Derived per side, so the cogroup keys of the two sides are distinct columns.
        return (side.join(sizes, on=keys, how="inner")
                    .withColumn(own, F.pmod(F.xxhash64(point), F.col(own_n)).cast("int"))
                    .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_n) - 1)))
                    .select(*(F.col(g).alias(g) for g in gkeys), *cols, *zs).groupBy(*gkeys))
    return (chunks(rec, "rc", "q", "dc", "p", "rkey", ["rkey"])
            .cogroup(chunks(don, "dc", "p", "rc", "q", "pid", ["pid", "id", "n"]))
            .applyInPandas(_nearest(shared, nf, k), PLACE_SCHEMA))


def _by_feature(places: DataFrame, wanted: DataFrame) -> DataFrame:
    """A row per feature that the places' layer fills in (the same for all of its receivers)."""
    return places.join(F.broadcast(wanted), "layer")


def _top_places(found: DataFrame, k: int) -> DataFrame:
    """The k nearest places of each receiver and feature, once each. They hold its k
    nearest donors: a donor of another place comes after the first donor of each of them."""
    w = Window.partitionBy("rkey", "feature").orderBy(F.round("dist", 9), "id", "pid")
    return found.withColumn("rk", F.dense_rank().over(w)).filter(F.col("rk") <= k).drop("rk").dropDuplicates(["rkey", "feature", "pid"])


def _top_donors(near: DataFrame, places: DataFrame, k: int) -> DataFrame:
    """The donors of the nearest places, and of those the k nearest."""
    donors = (near.select("rkey", "feature", "pid", "dist").join(places.select("pid", "members"), "pid")
                  .select("rkey", "feature", "dist", F.explode("members").alias("m"))
                  .select("rkey", "feature", F.col("m.id").alias("donor"),
                          F.struct("dist", F.get(F.col("m.x"), F.col("feature")).alias("value")).alias("at"))
                  .groupBy("rkey", "feature", "donor").agg(F.min("at").alias("at"))
                  .select("rkey", "feature", "donor", "at.dist", "at.value"))
    return _top_k(donors, k)


def _top_k(cand: DataFrame, k: int, keys=("rkey", "feature")) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.round("dist", 9), F.col("donor"))
    return cand.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k).drop("rn")


@dataclass
class Layers:
    """Receivers and donors by (shared coordinates, donor pattern)."""
    receivers: DataFrame     # rkey, layer, R, D, S, n_shared, z0..
    donors: DataFrame        # id, layer, S, z0.., x0..
    sizes: dict[int, int]    # donors by layer
    shared: dict[int, int]   # shared coordinates by layer
    wanted: DataFrame        # layer, feature: what the layer's donors have and its receivers lack


def _layers(receivers: DataFrame, donors: DataFrame, rec_patterns: dict[int, int], don_patterns: dict[int, int], nf: int) -> Layers | None:
    """None if no receiver shares a coordinate with a donor of a feature it lacks."""
    spark = receivers.sparkSession
    full = (1 << nf) - 1
    # Receiver patterns with the same S share the layer's donor copies.
    layer_ids: dict[tuple[int, int], int] = {}
    rec_rows = []
    for r in rec_patterns:
        for d in don_patterns if r != full else ():
            s = r & d
            if s and (d & ~r):
                rec_rows.append((layer_ids.setdefault((s, d), len(layer_ids)), r, d, s, bin(s).count("1")))
    if not rec_rows:
        return None
    don_rows = [(layer, d, s) for (s, d), layer in layer_ids.items()]
    # At most (observed patterns)^2 rows: bounded by the feature count, not the data.
    rl = spark.createDataFrame(rec_rows, "layer int, R int, D int, S int, n_shared int")
    dl = spark.createDataFrame(don_rows, "layer int, D int, S int")
    wanted = spark.createDataFrame([(layer, i) for layer, d, s in don_rows for i in range(nf) if (d & ~s) >> i & 1], "layer int, feature int")
    zs, xs = [f"z{i}" for i in range(nf)], [f"x{i}" for i in range(nf)]
    return Layers(receivers.join(F.broadcast(rl), receivers["pat"] == rl["R"], "inner").select("rkey", "layer", "R", "D", "S", "n_shared", *zs),
                  donors.join(F.broadcast(dl), donors["pat"] == dl["D"], "inner").select("id", "layer", "S", *zs, *xs),
                  {layer: don_patterns[d] for layer, d, _ in don_rows}, {layer: s for layer, _, s in don_rows}, wanted)


def _grid_candidates(layers: Layers, places: DataFrame, nf: int, k: int, cell_width: float, chunk_rows: int, whole: bool):
    """Exact nearest places for receivers with a usable radius; returns
    (places by feature, receivers left over). ``whole``: a cell spans all
    values, so the own cell holds every place of the layer and nobody is left."""
    cell_cols = [f"c{i}" for i in range(nf)]
    in_s = [F.col("S").bitwiseAND(F.lit(1 << i)) != 0 for i in range(nf)]

    def cell(x):
        return F.lit(0).cast("long") if whole else F.floor(x / F.lit(cell_width)).cast("long")
    cells = [F.when(in_s[i], cell(F.col(f"z{i}"))).otherwise(F.lit(0)).cast("long").alias(f"c{i}") for i in range(nf)]
    rec_l, don_l = layers.receivers.select("*", *cells), places.select("layer", "pid", "id", "n", *(f"z{i}" for i in range(nf)), *cells)

    # Phase 1: own cell (and bucket mates). U_f = k-th distance of feature f over
    # all layers; a layer is then searched within the largest U_f of its features.
    own = _top_places(_by_feature(_cell_search(rec_l, don_l, cell_cols, layers.shared, nf, k, chunk_rows), layers.wanted), k).checkpoint()
    if whole:
        return own, None
    upto = F.sum("n").over(Window.partitionBy("rkey", "feature").orderBy("dist").rowsBetween(Window.unboundedPreceding, 0))
    u_f = (own.withColumn("upto", upto).groupBy("rkey", "feature")
              .agg(F.sum("n").alias("n"), F.min(F.when(F.col("upto") >= k, F.col("dist"))).alias("kth")))
    need = rec_l.select("rkey", "layer")
    radius = (_by_feature(need, layers.wanted).join(u_f, on=["rkey", "feature"], how="left")
                  .groupBy("rkey", "layer")
                  .agg(F.max(F.when(F.col("n") >= k, F.col("kth"))).alias("U"),
                       F.min(F.coalesce(F.col("n") >= k, F.lit(False)).cast("int")).alias("all_k")))
    scale = F.sqrt(F.lit(float(nf)) / F.col("n_shared"))
    # Read by the test for the next level and by phase 2.
    probe = (rec_l.join(radius, on=["rkey", "layer"], how="left")
                  .withColumn("Uz", F.col("U") / scale + F.lit(1e-9)).checkpoint())
    usable = F.coalesce((F.col("all_k") == 1) & (F.col("Uz") <= F.lit(cell_width)), F.lit(False))
    # A receiver that lacks a radius in any of its layers goes to the next level.
    left = (probe.groupBy("rkey").agg(F.min(usable.cast("int")).alias("ok"))
                 .filter(F.col("ok") == 0).select("rkey"))

    # Phase 2: neighbouring cells within the radius (one step per coordinate at most).
    # The squared gap to the cell grows coordinate by coordinate, and cells beyond the
    # radius go before the next coordinate is expanded.
    near = probe.filter(usable).withColumn("gap2", F.lit(0.0)).withColumn("differs", F.lit(False))
    for i in range(nf):
        z, c, n = F.col(f"z{i}"), F.col(f"c{i}"), F.col(f"n{i}")
        lo, hi = cell(z - F.col("Uz")), cell(z + F.col("Uz"))
        near = near.withColumn(f"n{i}", F.explode(F.when(in_s[i], F.sequence(lo, hi))
                                                   .otherwise(F.array(F.lit(0).cast("long")))))
        g = (F.when(n < c, z - (n + 1) * F.lit(cell_width))
              .when(n > c, n * F.lit(cell_width) - z).otherwise(F.lit(0.0)))
        near = (near.withColumn("gap2", F.col("gap2") + F.when(in_s[i], g * g).otherwise(F.lit(0.0)))
                    .withColumn("differs", F.col("differs") | (n != c))
                    .filter(F.col("gap2") <= F.col("Uz") * F.col("Uz")))
    near = (near.filter("differs")
                .select("rkey", "layer", *[f"z{i}" for i in range(nf)],
                        *[F.col(f"n{i}").alias(f"c{i}") for i in range(nf)]))
    ring = _by_feature(_cell_search(near, don_l, cell_cols, layers.shared, nf, k, chunk_rows), layers.wanted)
    return _top_places(own.unionByName(ring), k), left


@dataclass
class Points:
    """Both sides of the search, and what filling in needs."""
    clean: DataFrame
    receivers: DataFrame     # rkey, __vec, pat, z0..: one per distinct vector with a missing feature
    donors: DataFrame        # id, pat, z0.., x0..
    features: list[str]
    means: list
    span: float              # widest range of a feature, in deviations
    any_missing: object
    layered: dict = field(default_factory=dict)  # layers and places by k, for both methods of search


def points(df: DataFrame, features: list[str], id_col: str, k: int) -> Points:
    """``receivers`` is None if no row lacks a feature."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    clean = df
    for f in features:
        c = F.col(f).cast("double")
        clean = clean.withColumn(f, F.when(~F.isnan(c), c))
    any_missing = F.lit(False)
    for f in features:
        any_missing = any_missing | F.col(f).isNull()
    # Read by the statistics, both sides of the search and the join back.
    clean = clean.checkpoint()
    means, sds, span, n_incomplete = _stats(clean, features, any_missing)
    if n_incomplete == 0:
        return Points(clean, None, None, features, means, span, any_missing)

    zcols = [((F.col(f) - F.lit(means[i] if means[i] is not None else 0.0)) / F.lit(sds[i])).alias(f"z{i}")
             for i, f in enumerate(features)]
    xcols = [F.col(f).alias(f"x{i}") for i, f in enumerate(features)]
    pat = sum((F.col(f).isNotNull().cast("int") * F.lit(1 << i) for i, f in enumerate(features)), F.lit(0))
    vec = F.struct(*[F.col(f) for f in features])
    # One receiver per distinct vector, keyed by its smallest row id (exact, unique).
    receivers = (clean.filter(any_missing).groupBy(vec.alias("__vec"))
                      .agg(F.min(F.col(id_col).cast("long")).alias("rkey")))
    receivers = receivers.select("rkey", "__vec",
                                 sum((F.col(f"__vec.{f}").isNotNull().cast("int") * F.lit(1 << i)
                                      for i, f in enumerate(features)), F.lit(0)).alias("pat"),
                                 *[((F.col(f"__vec.{f}") - F.lit(means[i] or 0.0)) /
                                    F.lit(sds[i])).alias(f"z{i}") for i, f in enumerate(features)]).checkpoint()
    # At most k donors per distinct vector: the smallest ids (Spark limits each
    # window group per task before the shuffle, so a hot vector sends k rows).
    wv = Window.partitionBy(*[F.col(f) for f in features]).orderBy(F.col(id_col).cast("long"))
    donors = (clean.withColumn("__rn", F.row_number().over(wv)).filter(F.col("__rn") <= k)
                   .select(F.col(id_col).cast("long").alias("id"), pat.alias("pat"), *zcols, *xcols)).checkpoint()
    return Points(clean, receivers, donors, features, means, span, any_missing)


def _pattern_counts(side: DataFrame) -> dict[int, int]:
    """Rows per observed null pattern: at most 2^n_features rows reach the driver."""
    return {r["pat"]: r["n"] for r in side.groupBy("pat").agg(F.count(F.lit(1)).alias("n")).collect()}


def _layered(pts: Points, k: int):
    """(layers, places), or None if there are no layers."""
    if k not in pts.layered:
        nf = len(pts.features)
        layers = _layers(pts.receivers, pts.donors, _pattern_counts(pts.receivers), _pattern_counts(pts.donors), nf)
        pts.layered[k] = layers and (layers, knn_index.places(layers.donors, nf, k).checkpoint())
    return pts.layered[k]


def neighbours(pts: Points, k: int = C.KNN_NEIGHBOURS, cell_width: float = CELL_WIDTH, chunk_rows: int = CHUNK_ROWS,
               method: str = "exact") -> DataFrame:
    """(rkey, feature, donor, dist, value, rn): the k nearest donors of each receiver
    and missing feature. ``method``: ``exact``, or ``lsh``, which may miss some."""
    if method not in ("exact", "lsh"):
        raise ValueError(f"unknown method {method!r}")
    nf = len(pts.features)
    layered = _layered(pts, k)
    if layered is None:
        return _top_k(pts.clean.sparkSession.createDataFrame([], CAND_SCHEMA), k)
    layers, places = layered
    if method == "lsh":
        near, left = _lsh_candidates(layers, places, nf, k, chunk_rows)
    else:
        near, left = _grid_candidates(layers, places, nf, k, cell_width, chunk_rows, cell_width > pts.span)
    if left is None:
        return _top_donors(near, places, k)
    left = left.checkpoint()
    if left.isEmpty():
        return _top_donors(near, places, k)
    far = knn_index.best_first(layers.receivers.join(left, "rkey", "left_semi").checkpoint(), places,
                               lambda rec, don: _cell_search(rec, don, ["cell"], layers.shared, nf, k, chunk_rows),
                               nf, k, pts.span, cell_width)
    far = _top_places(_by_feature(far, layers.wanted), k)
    return _top_donors(near.join(left, "rkey", "left_anti").unionByName(far), places, k)


def _lsh_candidates(layers: Layers, places: DataFrame, nf: int, k: int, chunk_rows: int):
    """The nearest places that share a key with their receiver in some table, and the
    receivers that lack k donors for some feature."""
    sizes = {r["layer"]: r["n"] for r in places.groupBy("layer").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per layer
    zs = [f"z{i}" for i in range(nf)]
    # Receivers are few bytes, and would stand in one task. Keys are read by the counts and the search.
    rec = layers.receivers.repartition(layers.receivers.sparkSession.sparkContext.defaultParallelism, "rkey")
    rec, don = (knn_index.lsh_cells(side, nf, sizes).checkpoint().withColumn("cell", F.explode("cells")).drop("cells")
                for side in (rec.select("rkey", "layer", "S", *zs), places.select("layer", "S", "pid", "id", "n", *zs)))
    found = _top_places(_by_feature(_cell_search(rec, don, ["cell"], layers.shared, nf, k, chunk_rows), layers.wanted), k).checkpoint()
    missing = layers.receivers.groupBy("rkey").agg(F.first("R").alias("R"))
    lacks = missing.select("rkey", F.explode(F.array_compact(F.array(*(
        F.when(F.col("R").bitwiseAND(F.lit(1 << i)) == 0, F.lit(i)) for i in range(nf))))).alias("feature"))
    n = found.groupBy("rkey", "feature").agg(F.sum("n").alias("n"))
    left = lacks.join(n, ["rkey", "feature"], "left").filter(F.coalesce("n", F.lit(0)) < k).select("rkey").distinct()
    return found, left


def impute_knn(df: DataFrame, features: list[str], id_col: str = "INGRESO_ACTUAL",
               k: int = C.KNN_NEIGHBOURS, cell_width: float = CELL_WIDTH, chunk_rows: int = CHUNK_ROWS,
               method: str = "exact") -> DataFrame:
    """Replace NULL/NaN features by the distance-weighted mean of the k nearest donors."""
    pts = points(df, features, id_col, k)
    if pts.receivers is None:
        return pts.clean
    top = neighbours(pts, k, cell_width, chunk_rows, method)
    clean, receivers, any_missing, nf, means = pts.clean, pts.receivers, pts.any_missing, len(features), pts.means
    vec = F.struct(*[F.col(f) for f in features])
    zero = F.max((F.col("dist") == 0).cast("int")).over(Window.partitionBy("rkey", "feature"))
    weighted = top.withColumn("wt", F.when(zero == 1, (F.col("dist") == 0).cast("double"))
                                     .otherwise(F.lit(1.0) / F.col("dist")))
    imputed = weighted.groupBy("rkey", "feature").agg(
        (F.sum(F.col("wt") * F.col("value")) / F.sum("wt")).alias("value"))
    # One row per distinct receiver vector, one column per feature.
    wide = imputed.groupBy("rkey").pivot("feature", list(range(nf))).agg(F.first("value"))
    fills = receivers.select("rkey", F.col("__vec").alias("__fvec")).join(wide, on="rkey", how="left")
    fills = fills.select("rkey", "__fvec", *[F.col(str(i)).alias(f"__fill{i}") if str(i) in wide.columns
                                             else F.lit(None).cast("double").alias(f"__fill{i}")
                                             for i in range(nf)])
    # Complete rows pass through; only incomplete rows join their vector's fills.
    complete = clean.filter(~any_missing)
    incomplete = clean.filter(any_missing).withColumn("__vec", vec)
    joined = incomplete.join(fills, on=incomplete["__vec"].eqNullSafe(fills["__fvec"]), how="left")
    for i, f in enumerate(features):
        mean = F.lit(means[i]).cast("double")
        joined = joined.withColumn(f, F.when(F.col(f).isNotNull(), F.col(f))
                                       .otherwise(F.coalesce(F.col(f"__fill{i}"), mean)))
    joined = joined.select(*clean.columns)
    return complete.unionByName(joined)
