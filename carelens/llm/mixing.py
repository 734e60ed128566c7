"""Mixing sources to target weights, down a tree of domain, language and source.

1. Tokens per leaf are summed (one aggregation); a leaf can give its tokens up to
   ``max_epochs`` times.
2. The budget goes down the tree level by level. Among siblings it is split by
   their weights; a child that cannot take its share (all leaves below it are
   used up) takes what it has, and the shortage goes to its siblings by their
   weights. Only what a whole family cannot take reaches the parent's siblings,
   because the parent's own capacity is the sum of its children's. The split
   is a closed form over the siblings ordered by capacity per weight (windows over
   the tree's nodes, whole tokens, nothing lost to rounding).
3. A leaf's budget is a number of whole epochs and a rest. Every epoch has its own
   order, a hash of (seed, epoch, id); the rest is the prefix of the next epoch's
   order whose tokens fit into it.
4. The prefix is found without sorting a leaf in one task: tokens per (leaf,
   first 16 bits of the hash) are summed, a window over at most 65,536 such rows
   a leaf finds the bucket where the rest ends, and only that bucket's rows, a
   65,536th of the leaf, are ordered.

Result: every chosen row with ``copies``, how many times it is taken.

Defined cases: a null level value is a branch of its own; a null text has 0
tokens; rows with a null id are told apart by their text; rows with the same id
follow each other in an epoch's order. Branches without a weight in ``weights``
have weight 1, those of weight 0 get nothing, and what they could have taken goes to
their siblings. Empty tables give no rows. Other columns pass through whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Leaves up to which the table of leaf budgets is broadcast.
BROADCAST_ROWS = 100_000
#: Fixed value: what separates words.
SPACE = r"[ \t\n\x0B\f\r]+"


def word_count(text: Column) -> Column:
    """Words of a text; null: 0."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")).cast("long")


def _branch(value: Column) -> Column:
    """A level's value as a key that also tells null from any text."""
    return F.coalesce(F.concat(F.lit("v"), value.cast("string")), F.lit("n"))


def _big(x: Column) -> Column:
    return x.cast("decimal(19,0)")


def _share(children: DataFrame, parent: Sequence[str], key: str) -> DataFrame:
    """Adds ``grant`` to the children (w, cap, and the parent's budget ``given``)."""
    family = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    row = family.orderBy("per_weight", key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    full = _big(F.col("cap")) * _big(F.col("w_all") - F.col("w_before")) <= _big(F.col("given") - F.col("cap_before")) * _big(F.col("w"))
    rest_w = F.when(F.col("full"), 0).otherwise(F.col("w"))
    upto = (_big(F.col("left")) * _big(F.col("w_upto")))
    out = (children.withColumn("per_weight", F.col("cap") / F.col("w"))
           .withColumn("cap_before", F.sum("cap").over(row) - F.col("cap"))
           .withColumn("w_before", F.sum("w").over(row) - F.col("w"))
           .withColumn("w_all", F.sum("w").over(family))
           .withColumn("full", full)
           .withColumn("left", F.col("given") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(family))
           .withColumn("w_left", F.sum(rest_w).over(family))
           .withColumn("w_upto", F.sum(rest_w).over(row))
           .withColumn("now", upto).withColumn("before", _big(F.col("left")) * _big(F.col("w_upto") - F.col("w"))))
    grant = F.expr("CASE WHEN full THEN cap ELSE now div w_left - before div w_left END")
    return out.withColumn("grant", grant)


def leaf_budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[tuple, int], budget: int | None,
                 budget_share: float, max_epochs: int) -> DataFrame:
    """(levels, have, grant) from (levels, have); level columns hold ``_branch`` keys."""
    spark = leaves.sparkSession
    total = leaves.agg(F.sum("have")).first()[0] or 0
    want = int(total * budget_share) if budget is None else budget
    # Leaves below a weight of 0 give nothing, so no branch counts them as its capacity.
    caps = leaves.withColumn("cap", F.col("have") * max_epochs)
    for depth in range(1, len(levels) + 1):
        closed = [tuple("n" if v is None else f"v{v}" for v in k) for k, w in weights.items() if len(k) == depth and not int(w)]
        if closed:
            path = list(levels[:depth])
            caps = caps.join(F.broadcast(spark.createDataFrame(closed, ", ".join(f"`{p}` string" for p in path))), path, "left_anti")
    given = min(want, total * max_epochs)
    parents: DataFrame | None = None
    for depth in range(1, len(levels) + 1):
        path, above = list(levels[:depth]), list(levels[:depth - 1])
        nodes = caps.groupBy(*path).agg(F.sum("cap").alias("cap"))
        listed = [(*("n" if v is None else f"v{v}" for v in k), int(w)) for k, w in weights.items() if len(k) == depth]
        if listed:
            table = spark.createDataFrame(listed, ", ".join(f"`{p}` string" for p in path) + ", w long")
            nodes = nodes.join(table, path, "left").withColumn("w", F.coalesce("w", F.lit(1).cast("long")))
        else:
            nodes = nodes.withColumn("w", F.lit(1).cast("long"))
        nodes = nodes.filter(F.col("w") > 0)
        nodes = nodes.withColumn("given", F.lit(given).cast("long")) if parents is None else nodes.join(
            parents.select(*above, F.col("grant").alias("given")), above)
        parents = _share(nodes, above, path[-1]).select(*path, F.col("grant").cast("long").alias("grant"))
    return leaves.join(parents, list(levels))


def mix_sources(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[tuple, int], budget: int | None = None,
                budget_share: float = 1.0, max_epochs: int = 4, seed: str = "mix", id_col: str = "doc_id",
                text_col: str = "text", tokens: Column | None = None) -> DataFrame:
    """(row, branch, tokens, copies): the chosen rows of docs as structs, with
    the leaf's values, the row's tokens and how often it is taken.

    ``levels`` maps level names, root first, to columns of docs. ``weights`` maps
    paths of level values to whole numbers. The budget is ``budget`` tokens, or
    ``budget_share`` of the tokens there are."""
    names = [f"level_{k}" for k in range(len(levels))]
    rid = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text-"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
                       F.struct(*(v.cast("string").alias(k) for k, v in levels.items())).alias("branch"),
                       *(_branch(v).alias(n) for n, v in zip(names, levels.values(), strict=True)), rid.alias("rid"),
                       (word_count(F.col(text_col)) if tokens is None else F.coalesce(tokens.cast("long"), F.lit(0))).alias("tokens"))
    slim = rows.select(*names, "rid", "tokens").checkpoint()
    leaves = slim.groupBy(*names).agg(F.sum("tokens").alias("have")).checkpoint()
    plan = (leaf_budgets(leaves, names, weights, budget, budget_share, max_epochs)
            .withColumn("epochs", F.expr("CASE WHEN have > 0 THEN grant div have ELSE 0 END"))
            .withColumn("rest", F.col("grant") - F.col("epochs") * F.col("have"))
            .select(*names, "epochs", "rest").checkpoint())
    n = plan.count()
    small = (lambda t: F.broadcast(t)) if n <= BROADCAST_ROWS else (lambda t: t)
    place = F.md5(F.concat_ws("|", F.lit(seed), F.col("epochs").cast("string"), F.col("rid")))
    slot = F.conv(F.substring("place", 1, 4), 16, 10).cast("int")
    by_slot = (slim.join(small(plan), names).withColumn("place", place).withColumn("slot", slot)
               .groupBy(*names, "rest", "slot").agg(F.sum("tokens").alias("sum")))
    running = Window.partitionBy(*names).orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = (by_slot.withColumn("upto", F.sum("sum").over(running)).filter(F.col("upto") > F.col("rest"))
            .groupBy(*names).agg(F.min(F.struct("slot", (F.col("upto") - F.col("sum")).alias("before"))).alias("end")))
    # A leaf without an end takes all its rows once more (its rest is as large as all it has: only when it has no tokens).
    cut = (plan.join(ends, names, "left").withColumn("end_slot", F.coalesce("end.slot", F.lit(1 << 16)))
           .withColumn("room", F.col("rest") - F.coalesce("end.before", F.lit(0)))
           .select(*names, "epochs", "end_slot", "room").checkpoint())
    placed = rows.join(small(cut), names).withColumn("place", place).withColumn("slot", slot)
    clear = placed.filter(F.col("slot") != F.col("end_slot")).withColumn(
        "copies", F.col("epochs") + (F.col("slot") < F.col("end_slot")).cast("long"))
    order = Window.partitionBy(*names).orderBy("place", "rid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = placed.filter(F.col("slot") == F.col("end_slot")).withColumn(
        "copies", F.col("epochs") + (F.sum("tokens").over(order) <= F.col("room")).cast("long"))
    return clear.unionByName(edge).filter(F.col("copies") > 0).select("row", "branch", "tokens", F.col("copies").cast("long").alias("copies"))


def default_levels() -> dict[str, Column]:
    """Domain, language and source of the documents table. It has no domain
    column; a source's domain is its number modulo 4."""
    number = F.regexp_extract("source", "([0-9]+)$", 1)
    domain = F.when(number != "", F.concat(F.lit("d"), F.substring(number, -4, 4).cast("int") % 4))
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


#: Target weights of the registered query and the pipeline.
WEIGHTS = {("d0",): 1, ("d1",): 2, ("d2",): 3, ("d3",): 4,
           **{(d, lang): w for d in ("d0", "d1", "d2", "d3") for lang, w in (("en", 4), ("de", 2), ("fr", 2), ("es", 1))}}
BUDGET_SHARE, MAX_EPOCHS, SEED = 0.9, 2, "mix"
