"""Per-patient ordered operators that stay balanced when one patient is huge.

A plain ``lag() over (partition by patient ...)`` puts every row of a patient in
one task. If one patient held a third of the table, one task would do a third
of the work.

* ``lag_by_key``: one count per patient tells whether any history is longer than
  ``SLICE_ROWS``. If none is, one window does it. Otherwise long histories are cut
  into ranges of (date, tie key), so that even one day, one instant or the rows
  without a date are spread. The lag runs inside (patient, range), and the first row
  of a range takes its value in two steps: each range's last row, then the last row
  of the range before it. That table has at most ``SLICES`` rows a patient.
* ``latest_by_key``: ``max_by`` is an aggregate, so Spark pre-aggregates it on
  the map side and a hot patient costs one partial row per input partition.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: Rows of one key that stay in one range, ranges of a key at most, rows of a key
#: that are looked at for each bound, and keys up to which their bounds are broadcast.
SLICE_ROWS, SLICES, LOOKED_AT, BROADCAST_KEYS = 100_000, 256, 64, 1_000


def _place(order_col: str, tie_col: str) -> Column:
    """A row's place in its history: dates first and in order, then the tie key."""
    return F.struct(F.col(order_col).isNull().alias("undated"), F.col(order_col).alias("date"), F.col(tie_col).alias("tie"))


def history_bounds(df: DataFrame, long: DataFrame, key: str, order_col: str, tie_col: str, slice_rows: int) -> DataFrame:
    """(key, bounds) for the long histories (key, n): the places that cut one into
    ranges of similar size. A fixed share of a history's rows, chosen by a hash and
    about LOOKED_AT for each range, is sorted; every LOOKED_AT-th is a bound. A row's
    range depends on the row alone, so reruns and lost tasks see the same ranges."""
    ranges = F.least(F.lit(SLICES), F.ceil(F.col("n") / slice_rows))
    every = F.greatest(F.lit(1), F.floor(F.col("n") / (ranges * LOOKED_AT)))
    looked = (df.select(key, _place(order_col, tie_col).alias("place")).join(long, key)
                .withColumn("ranges", ranges).filter(F.pmod(F.xxhash64("place"), every) == 0)
                .groupBy(key).agg(F.sort_array(F.collect_list("place")).alias("places"), F.first("ranges").alias("ranges")))
    step = F.col("ranges").cast("double")
    cuts = F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1), F.col("ranges") - 1)),
                       lambda i: F.get("places", F.floor(i * F.size("places") / step).cast("int")))
    return looked.select(key, F.array_distinct(cuts).alias("bounds"))


def history_ranges(df: DataFrame, key: str, order_col: str, tie_col: str, slice_rows: int = SLICE_ROWS, out: str = "__range") -> DataFrame | None:
    """df with the number of each row's range of its history, null where the history
    is one range; None if every history is."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > slice_rows)
    n_long = counts.count()
    if not n_long:
        return None
    bounds = history_bounds(df, counts.checkpoint(), key, order_col, tie_col, slice_rows).checkpoint()
    bounds = F.broadcast(bounds) if n_long <= BROADCAST_KEYS else bounds
    place = _place(order_col, tie_col)
    number = F.size(F.filter("__bounds", lambda b: b <= F.col("__place")))
    return (df.withColumn("__place", place).join(bounds.withColumnRenamed("bounds", "__bounds"), key, "left")
              .withColumn(out, F.when(F.col("__bounds").isNotNull(), number)).drop("__bounds", "__place"))


def lag_by_key(df: DataFrame, key: str, order_col: str, tie_col: str,
               values: dict[str, str], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Add ``out = lag(src) over (partition by key order by order_col nulls last, tie_col)``.

    ``values`` maps output column -> source column. ``tie_col`` must be unique
    within a key, and numeric. Rows with a NULL key get NULL (a NULL patient has no history).
    """
    columns, no_key = df.columns, F.col(key).isNull()
    order = (F.col(order_col).asc_nulls_last(), F.col(tie_col).asc())
    alone = F.when(no_key, F.col(tie_col))          # rows without a key are dealt one by one
    ranged = history_ranges(df, key, order_col, tie_col, slice_rows)
    if ranged is None:
        history = Window.partitionBy(key, alone).orderBy(*order)
        return df.select(*columns, *(F.when(~no_key, F.lag(src).over(history)).alias(out) for out, src in values.items()))

    inside = Window.partitionBy(key, "__range", alone).orderBy(*order)
    packed = F.struct(*(F.col(src) for src in dict.fromkeys(values.values())))
    local = ranged.withColumn("__prev", F.lag(packed).over(inside))
    # The last row of each range carries its values to the next one of its key.
    ends = ranged.filter(F.col("__range").isNotNull()).groupBy(key, "__range").agg(F.max_by(packed, _place(order_col, tie_col)).alias("__end"))
    before = Window.partitionBy(key).orderBy("__range")
    carried = ends.select(F.col(key).alias("__key"), F.col("__range").alias("__of"), F.lag("__end").over(before).alias("__carried"))
    joined = local.join(carried, (F.col(key) == F.col("__key")) & (F.col("__range") == F.col("__of")), "left")
    known = F.coalesce("__prev", "__carried")
    return joined.select(*columns, *(F.when(~no_key, known.getField(src)).alias(out) for out, src in values.items()))


def latest_by_key(df: DataFrame, key: str, order_col: str, tie_col: str,
                  columns: list[str] | None = None, count_as: str | None = None) -> DataFrame:
    """One row per key: the row with the latest ``order_col`` (NULL dates last),
    ties to the highest ``tie_col``. Optionally counts rows per key.
    """
    cols = columns or [c for c in df.columns if c != key]
    rank = F.struct(F.col(order_col).isNotNull(), F.col(order_col), F.col(tie_col))
    aggs = [F.max_by(F.struct(*[F.col(c) for c in cols]), rank).alias("__latest")]
    if count_as:
        aggs.append(F.count(F.lit(1)).alias(count_as))
    out = df.groupBy(key).agg(*aggs)
    sel = [F.col(key)] + [F.col("__latest").getField(c).alias(c) for c in cols]
    if count_as:
        sel.append(F.col(count_as))
    return out.select(*sel)


def slice_bounds(df: DataFrame, order_col: str, n: int) -> list[float]:
    """At most n - 1 increasing bounds that cut the rows into n slices of similar
    size: one aggregate, at most n - 1 numbers to the driver."""
    if n < 2:
        return []
    shares = [k / n for k in range(1, n)]
    found = df.agg(F.percentile_approx(F.col(order_col).cast("double"), shares, 100 * n)).first()[0]
    return sorted(set(found or ()))


def ordered_scan(df: DataFrame, group_cols: list[str], order_col: str, sums: dict[str, str],
                 leads: dict[str, str] | None = None, descending: bool = True,
                 num_partitions: int | None = None, checkpointed: bool = False) -> DataFrame:
    """Running sums (and next-row values) within ``group_cols`` in ``order_col`` order.

    A window ``partitionBy(group).orderBy(order)`` would run each group in one task.
    Instead the range of ``order_col`` is cut at bounds that are computed once
    and then stand in the plan as literals, so a row's slice is a function of the
    row: every branch, rerun and lost task sees the same slices. Each (group, slice)
    computes local running sums, and a table with one row per (group, slice)
    supplies the sums of the earlier slices and the first row of the next one.
    ``order_col`` is numeric and unique within a group (aggregate by it first).

    ``sums``: output -> source column (inclusive running sum).
    ``leads``: output -> source column (value of the next row in order, NULL at the end).
    """
    leads = leads or {}
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    pid = "__slice"
    # Read by the bounds and by both branches below.
    df = df if checkpointed else df.checkpoint()
    bounds = slice_bounds(df, order_col, n)
    if bounds:
        cut = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol="__order", outputCol="__bucket", handleInvalid="keep")
        sliced = cut.transform(df.withColumn("__order", F.col(order_col).cast("double")))
        slice_id = F.col("__bucket").cast("int")
        sliced = sliced.withColumn(pid, -slice_id if descending else slice_id).drop("__order", "__bucket")
    else:
        sliced = df.withColumn(pid, F.lit(0))
    keys = group_cols + [pid]
    w_ord = Window.partitionBy(*keys).orderBy(order)
    w_run = w_ord.rowsBetween(Window.unboundedPreceding, 0)
    local = sliced
    for out, src in sums.items():
        local = local.withColumn(f"__run_{out}", F.sum(src).over(w_run))
    for out, src in leads.items():
        local = local.withColumn(f"__lead_{out}", F.lead(src).over(w_ord))
    # One row per (group, slice): slice totals and the slice's first row.
    slice_aggs = [F.sum(src).alias(f"__tot_{out}") for out, src in sums.items()]
    if leads:
        first = F.struct(*[F.col(src).alias(out) for out, src in leads.items()])
        slice_aggs.append((F.max_by if descending else F.min_by)(first, F.col(order_col)).alias("__first"))
    offs = sliced.groupBy(*keys).agg(*slice_aggs)
    w_next = Window.partitionBy(*group_cols).orderBy(pid)
    w_before = w_next.rowsBetween(Window.unboundedPreceding, -1)
    for out in sums:
        offs = offs.withColumn(f"__off_{out}", F.coalesce(F.sum(f"__tot_{out}").over(w_before), F.lit(0)))
    if leads:
        offs = offs.withColumn("__next_first", F.lead("__first").over(w_next))
    offs = offs.select(*[F.col(k).alias(f"__o_{k}") for k in keys],
                       *[c for c in offs.columns if c.startswith("__off_") or c == "__next_first"])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__o_{k}"))
    joined = local.join(offs, same, "left")
    for out in sums:
        joined = joined.withColumn(out, F.col(f"__run_{out}") + F.col(f"__off_{out}"))
    for out in leads:
        joined = joined.withColumn(out, F.coalesce(F.col(f"__lead_{out}"), F.col("__next_first").getField(out)))
    drop = [pid] + [c for c in joined.columns if c.startswith(("__run_", "__off_", "__lead_", "__o_"))]
    if leads:
        drop.append("__next_first")
    return joined.drop(*drop)


def exact_medians(df: DataFrame, value_cols: list[str], by: list[str] = ()) -> DataFrame:
    """(by, feature, median): the exact median of each column per group, NULL and
    NaN left out; a column without values has no row.

    Equal values are counted first (combined before the shuffle), then the middle
    ranks are found by ``ordered_scan``: no task holds a column's values."""
    by = list(by)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
                                for c in value_cols]))
    long = (df.select(*by, pairs.alias("__p")).select(*by, "__p.feature", "__p.value")
              .filter(F.col("value").isNotNull() & ~F.isnan("value")))
    keys = by + ["feature"]
    return weighted_medians(long.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n")), keys)


def approximate_medians(df: DataFrame, value_cols: list[str], error: float) -> DataFrame:
    """(feature, median): a value of the column whose rank is within ``error`` of the
    middle, as a share of its values; NULL and NaN left out. Quantile sketches of a
    bounded size, merged in one aggregate: one pass, one small row a task."""
    if not 0 < error < 0.5:
        raise ValueError(f"the rank error is a share of the rows between 0 and 0.5, not {error}")
    accuracy = math.ceil(1 / error)
    values = [F.col(c).cast("double") for c in value_cols]
    row = df.agg(*(F.percentile_approx(F.when(~F.isnan(v), v), 0.5, accuracy).alias(f"q{i}") for i, v in enumerate(values)))
    listed = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"q{i}").alias("median")) for i, c in enumerate(value_cols))))
    return row.select(listed.alias("m")).select("m.*").filter(F.col("median").isNotNull())


def weighted_medians(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, median) from (keys, value, n): how often each value occurs."""
    if not keys:
        return weighted_medians(counts.withColumn("__all", F.lit(0)), ["__all"]).drop("__all")
    counts = counts.filter(F.col("value").isNotNull() & ~F.isnan("value")).select(*keys, "value", "n").checkpoint()
    totals = counts.groupBy(*[F.col(k).alias(f"__t_{k}") for k in keys]).agg(F.sum("n").alias("total"))
    ranked = ordered_scan(counts, keys, "value", sums={"upto": "n"}, descending=False, checkpointed=True)
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)

    def holds(rank):
        return (F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto"))

    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__t_{k}"))
    middle = ranked.join(totals, same, "inner").filter(holds(low) | holds(high))
    return middle.groupBy(*keys).agg(((F.min("value") + F.max("value")) / 2).alias("median"))
