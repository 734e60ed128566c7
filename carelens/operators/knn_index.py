"""Two more ways to the donors of a receiver, over the layers of ``knn``.

``best_first``: exact, for receivers whose neighbours are not in or next to their own
grid cell (far outliers, sparse corners). The donors' cells form a tree: a leaf is an
occupied cell, with the count and the tight box of its donors; a parent takes
``STEP`` cells to each side. The search goes down level by level. At each level a
receiver holds some cells, each with the least and the greatest distance to its box;
the k-th donor can't be farther than the greatest distance of the nearest cells that
hold k, over all layers, so cells that begin beyond it go before the next level is
opened. Only donors of the leaves that are left are compared. No level compares a
receiver with a layer, however far out it lies. A row of the search is a place: the
donors of a layer that agree in all shared coordinates.

``lsh``: approximate. Random projections (``BucketedRandomProjectionLSH``) of the shared
coordinates, several to a key, in several tables; a receiver is compared with the
places that share a key with it in some table, and distances are exact. Layers of more
than ``COARSE`` places take finer buckets and one more projection to a key whenever they
grow by a factor of ``SPREAD / FINE_BUCKET``, so that a key holds about ``PER_KEY`` places
whatever the layer's size. Receivers that find fewer than k donors for a feature are
searched by ``best_first``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Cells of a level that make up one of the next; leaves are that much finer than grid cells.
STEP = 8
#: Random projections: tables, projections to a key, width of a projection's buckets, seed.
TABLES, PROJECTIONS, BUCKET, SEED = 8, 3, 3.0, 7
#: Places of a layer up to which the above holds; the bucket's width beyond, the range that
#: most values of a projection fall into (both in deviations), and places wanted to a key.
COARSE, FINE_BUCKET, SPREAD, PER_KEY = 8192, 2.0, 3.5, 512


def _boxes(cells: DataFrame, nf: int, lo, hi, n: Column) -> DataFrame:
    """(layer, cell, n, lo, hi): counts and tight boxes by cell."""
    ends = [f(c).alias(f"{name}{i}") for i in range(nf) for name, f, c in (("l", F.min, lo(i)), ("h", F.max, hi(i)))]
    return cells.groupBy("layer", "cell").agg(F.sum(n).alias("n"), *ends).select(
        "layer", "cell", "n", F.array(*(F.col(f"l{i}") for i in range(nf))).alias("lo"), F.array(*(F.col(f"h{i}") for i in range(nf))).alias("hi"))


def _up(cell: Column) -> Column:
    return F.transform(cell, lambda c: F.floor(c / STEP).cast("long"))


def cell_tree(donors: DataFrame, nf: int, span: float, width: float, n: str | None = None) -> list[DataFrame]:
    """The levels of cells over donors (layer, cell, z0..), leaves first. The last
    level's cells are as wide as the values' range. ``n``: the column with the
    donors that a row stands for (None: one)."""
    levels = [_boxes(donors, nf, lambda i: F.col(f"z{i}"), lambda i: F.col(f"z{i}"), F.col(n) if n else F.lit(1)).checkpoint()]
    while width <= 2 * span:
        below = levels[-1].withColumn("cell", _up(F.col("cell")))
        levels.append(_boxes(below, nf, lambda i: F.col("lo")[i], lambda i: F.col("hi")[i], F.col("n")).checkpoint())
        width *= STEP
    return levels


def _distances(nf: int) -> tuple[Column, Column]:
    """Least and greatest distance of z to the box, over the shared coordinates."""
    least = greatest = F.lit(0.0)
    for i in range(nf):
        z, lo, hi = F.col(f"z{i}"), F.col("lo")[i], F.col("hi")[i]
        shared = F.col("S").bitwiseAND(F.lit(1 << i)) != 0
        gap, far = F.greatest(lo - z, z - hi, F.lit(0.0)), F.greatest(F.abs(z - lo), F.abs(z - hi))
        least = least + F.when(shared, gap * gap).otherwise(0.0)
        greatest = greatest + F.when(shared, far * far).otherwise(0.0)
    scale = F.sqrt(F.lit(float(nf)) / F.col("n_shared"))
    return scale * F.sqrt(least), scale * F.sqrt(greatest)


def _pruned(held: DataFrame, nf: int, k: int, zs: list[str]) -> DataFrame:
    """The held cells that may hold one of the k nearest donors of some feature."""
    least, greatest = _distances(nf)
    held = held.select("rkey", "layer", "R", "D", "S", "n_shared", "cell", "n", *zs, least.alias("least"), greatest.alias("greatest"))
    wanted = F.array_compact(F.array(*(F.when((F.col("D").bitwiseAND(F.lit(1 << i)) != 0) & (F.col("R").bitwiseAND(F.lit(1 << i)) == 0),
                                              F.lit(i)) for i in range(nf))))
    nearest = Window.partitionBy("rkey", "feature").orderBy("greatest", "layer", "cell").rowsBetween(Window.unboundedPreceding, 0)
    # No donor's k-th distance exceeds that of the cell where the count reaches k.
    radius = (held.select("rkey", "layer", "cell", "n", "greatest", F.explode(wanted).alias("feature"))
              .withColumn("upto", F.sum("n").over(nearest)).groupBy("rkey", "feature")
              .agg(F.min(F.when(F.col("upto") >= k, F.col("greatest"))).alias("radius"))
              .groupBy("rkey").agg(F.map_from_entries(F.collect_list(F.struct("feature", F.coalesce("radius", F.lit(float("inf"))).alias("r")))).alias("radii")))
    within = F.array_max(F.transform(wanted, lambda f: F.element_at("radii", f)))
    # A little more than the radius: rounding errors, and distances are compared to nine places.
    reach = within * F.lit(1 + 1e-14) + F.lit(2e-9)
    return held.join(radius, "rkey").filter(F.col("least") <= reach).drop("radii", "least", "greatest")


def leaf_cells(receivers: DataFrame, tree: list[DataFrame], nf: int, k: int) -> DataFrame:
    """(rkey, layer, cell, n, z0..) of the leaves to be searched for receivers (rkey,
    layer, R, D, S, n_shared, z0..)."""
    zs = [f"z{i}" for i in range(nf)]
    held = _pruned(receivers.join(tree[-1], "layer"), nf, k, zs).checkpoint()
    for level in reversed(tree[:-1]):
        children = level.select("layer", F.col("cell").alias("child"), _up(F.col("cell")).alias("cell"), F.col("n").alias("n_child"), "lo", "hi")
        opened = held.join(children, ["layer", "cell"]).select(
            "rkey", "layer", "R", "D", "S", "n_shared", F.col("child").alias("cell"), F.col("n_child").alias("n"), "lo", "hi", *zs)
        held = _pruned(opened, nf, k, zs).checkpoint()
    return held.select("rkey", "layer", "cell", "n", *zs)


def layer_cell(nf: int, width: float) -> Column:
    """A point's cell over the shared coordinates ``S``."""
    return F.array(*(F.when(F.col("S").bitwiseAND(F.lit(1 << i)) != 0, F.floor(F.col(f"z{i}") / F.lit(width))).otherwise(0).cast("long") for i in range(nf)))


def _inside(i: int) -> Column:
    return F.col("S").bitwiseAND(F.lit(1 << i)) != 0


def once_per_place(donors: DataFrame, nf: int, k: int) -> DataFrame:
    """The donors with the k smallest ids of those that agree in all shared coordinates
    of their layer: they are equally far from every receiver (Spark limits each
    window group per task before the shuffle)."""
    place = [F.when(_inside(i), F.col(f"z{i}")) for i in range(nf)]
    first = Window.partitionBy("layer", *place).orderBy("id")
    return donors.withColumn("__rk", F.dense_rank().over(first)).filter(F.col("__rk") <= k).drop("__rk")


def places(donors: DataFrame, nf: int, k: int) -> DataFrame:
    """(pid, layer, S, id, n, members, z0..): the distinct shared coordinates of each layer
    with their ``members`` (id, x), the donors with the k smallest ids, ``n`` of them, the first
    being ``id``. ``pid`` numbers them and holds once the rows are stored."""
    zs = [f"z{i}" for i in range(nf)]
    # A coordinate is compared if it is shared, and else may fill in a gap: one value of the two is enough.
    held = once_per_place(donors.select("layer", "S", "id", *(F.when(_inside(i), F.col(z)).otherwise(F.col(f"x{i}")).alias(z) for i, z in enumerate(zs))), nf, k)
    members = (held.select("layer", "S", "id", *(F.when(_inside(i), F.col(z)).alias(z) for i, z in enumerate(zs)),
                           F.array(*(F.when(~_inside(i), F.col(z)) for i, z in enumerate(zs))).alias("x"))
               .groupBy("layer", "S", *zs, "id").agg(F.min("x").alias("x")))
    return (members.groupBy("layer", "S", *zs)
            .agg(F.min("id").alias("id"), F.count(F.lit(1)).cast("int").alias("n"), F.collect_list(F.struct("id", "x")).alias("members"))
            .withColumn("pid", F.monotonically_increasing_id()))


def best_first(receivers: DataFrame, places: DataFrame, search, nf: int, k: int, span: float, width: float) -> DataFrame:
    """Candidates of receivers in layers and of ``places``. ``search(rec, don)``
    compares rows of equal (layer, cell)."""
    places = places.drop("members").withColumn("cell", layer_cell(nf, width / STEP)).checkpoint()
    leaves = leaf_cells(receivers, cell_tree(places, nf, span, width / STEP, "n"), nf, k)
    met = places.join(leaves.select("layer", "cell").distinct(), ["layer", "cell"], "left_semi").checkpoint()
    return search(leaves.drop("n"), met)


def lsh_grain(n_places: int, projections: int = PROJECTIONS, bucket: float = BUCKET) -> tuple[int, float]:
    """(projections to a key, width of their buckets) for a layer of so many places."""
    if n_places <= COARSE:
        return projections, bucket
    return max(projections, math.ceil(math.log(n_places / PER_KEY) / math.log(SPREAD / FINE_BUCKET))), FINE_BUCKET


def _drawn(spark: SparkSession, nf: int, most: int, projections: int, bucket: float, tables: int) -> np.ndarray:
    """Unit vectors by (table, projection, coordinate), at least ``projections`` to a table."""
    # Fitting draws the projections; it needs a vector's length only. More of them leave the first ones as they are.
    drawn = BucketedRandomProjectionLSH(inputCol="masked", outputCol="hashes", numHashTables=tables * most, bucketLength=bucket, seed=SEED)
    model = drawn.fit(spark.range(1).select(array_to_vector(F.array(*(F.lit(0.0) for _ in range(nf)))).alias("masked")))
    rows = np.array(model._java_obj.randMatrix().toArray()).reshape(nf, tables * most).T
    first, more = rows[:tables * projections], rows[tables * projections:]
    return np.concatenate((first.reshape(tables, projections, nf), more.reshape(tables, most - projections, nf)), axis=1)


def lsh_cells(points: DataFrame, nf: int, sizes: dict[int, int], tables: int = TABLES, projections: int = PROJECTIONS, bucket: float = BUCKET) -> DataFrame:
    """Adds ``cells``: by table, a number made of it and of the buckets of the projections
    in that table's key (equal numbers of different keys are only compared in vain).
    ``sizes``: places by layer. A batch is projected by products of arrays."""
    grains = {layer: lsh_grain(n, projections, bucket) for layer, n in sizes.items()}
    vectors = _drawn(points.sparkSession, nf, max(m for m, _ in grains.values()), projections, bucket, tables)

    @F.pandas_udf("array<long>")
    def cells(layer: pd.Series, *z: pd.Series) -> pd.Series:
        layer = layer.to_numpy()
        out = np.empty((len(layer), tables), dtype=np.int64)
        for one in np.unique(layer):
            at = np.flatnonzero(layer == one)
            m, width = grains[int(one)]
            sums = np.zeros((at.size, tables, m))
            for i, c in enumerate(z):           # in this order for any number of rows: equal points get equal sums
                sums += c.to_numpy(dtype=float)[at][:, None, None] * vectors[None, :, :m, i]
            buckets = np.floor(sums / width).astype(np.int64).astype(np.uint64)
            key = np.broadcast_to(np.arange(1, tables + 1, dtype=np.uint64), (at.size, tables)).copy()
            for p in range(m):
                key = (key ^ buckets[:, :, p]) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            out[at] = key.view(np.int64)
        return pd.Series(list(out))
    return points.withColumn("cells", cells("layer", *(F.when(_inside(i), F.col(f"z{i}")).otherwise(0.0) for i in range(nf))))


def lsh_keys(points: DataFrame, nf: int, sizes: dict[int, int], tables: int = TABLES, projections: int = PROJECTIONS, bucket: float = BUCKET) -> DataFrame:
    """A row per table, with ``cell`` (``lsh_cells``)."""
    return lsh_cells(points, nf, sizes, tables, projections, bucket).withColumn("cell", F.explode("cells")).drop("cells")
