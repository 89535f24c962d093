"""Exact global order statistics without a single-partition window.

A running total, a quantile or a rank over a whole table is split in two levels: the keys are cut
into a bounded number of ranges, every range is handled by its own window partition, and only the
per-range totals (at most ``buckets`` rows per group) pass through one small window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 128
HASH_DIGITS = 3  # 16**3 hash ranges


def running_totals(table: DataFrame, value: str, sums: dict[str, str], group: Sequence[str] = (),
                   descending: bool = False, buckets: int = BUCKETS, then: Sequence[str] = ()) -> DataFrame:
    """Inclusive running sums of ``sums`` (output name -> input column) in order of ``value`` and ``then``.

    ``table`` holds one row per (group, value, then): aggregate ties first, so a hot value is one row.
    ``then`` must have few distinct keys, as all rows of a value meet in one range.
    ``group`` must have a small number of distinct keys (labels, metric names).
    """
    group = list(group)
    cuts = [i / buckets for i in range(1, buckets)]
    bounds = F.percentile_approx(F.col(value).cast("double"), cuts, 10000)
    if group:
        ranged = table.join(F.broadcast(table.groupBy(*group).agg(bounds.alias("__bounds"))), group)
    else:
        ranged = table.withColumn("__bounds", table.agg(bounds.alias("b")).scalar())
    # the number of bounds below the value is its place among them; a lambda over 127 bounds costs several times as much
    ranged = ranged.withColumn("__double", F.col(value).cast("double")).withColumn("__range", F.coalesce(
        F.array_position(F.sort_array(F.array_append("__bounds", F.col("__double"))), F.col("__double")) - 1,
        F.lit(0)).cast("int")).drop("__bounds", "__double")

    order = F.col("__range").desc() if descending else F.col("__range").asc()
    before = (Window.partitionBy(*group, F.lit(0)).orderBy(order)
              .rowsBetween(Window.unboundedPreceding, -1))
    totals = ranged.groupBy(*group, "__range").agg(
        *[F.sum(source).alias(f"__t_{name}") for name, source in sums.items()])
    offsets = totals.select(
        *group, "__range",
        *[F.coalesce(F.sum(f"__t_{name}").over(before), F.lit(0)).alias(f"__o_{name}")
          for name in sums])
    inner_order = F.col(value).desc() if descending else F.col(value).asc()
    inside = (Window.partitionBy(*group, "__range").orderBy(inner_order, *then)
              .rowsBetween(Window.unboundedPreceding, 0))
    joined = ranged.join(F.broadcast(offsets), [*group, "__range"])
    for name, source in sums.items():
        joined = joined.withColumn(name, F.sum(source).over(inside) + F.col(f"__o_{name}"))
    return joined.drop("__range", *[f"__o_{name}" for name in sums])


def exact_quantiles(table: DataFrame, value: str, points: dict[str, float],
                    group: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolated quantiles of ``value``: one row per group, one column per point."""
    group = list(group)
    counts = (table.where(F.col(value).isNotNull())
              .groupBy(*group, F.col(value).cast("double").alias("__v"))
              .agg(F.count(F.lit(1)).alias("__n")))
    ranked = running_totals(counts, "__v", {"__cum": "__n"}, group)
    if group:
        sizes = counts.groupBy(*group).agg(F.sum("__n").alias("__total"))
        ranked = ranked.join(F.broadcast(sizes), group)
    else:
        ranked = ranked.withColumn("__total", counts.agg(F.sum("__n").alias("t")).scalar())

    def at(rank: Column) -> Column:
        """Value holding the zero-based ``rank``."""
        holds = (F.col("__cum") > rank) & (F.col("__cum") - F.col("__n") <= rank)
        return F.max(F.when(holds, F.col("__v")))

    aggregates = []
    for name, point in points.items():
        place = (F.col("__total") - 1) * F.lit(float(point))
        low, high = F.floor(place), F.ceil(place)
        weight = F.max(place - low)
        aggregates.append((at(low) + (at(high) - at(low)) * weight).alias(name))
    return ranked.groupBy(*group).agg(*aggregates) if group else ranked.agg(*aggregates)


def with_middle(table: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """Marks the value or two values in the middle of a key's weighted rows, for ``middle`` to take up.

    A key's rows are sorted, once they have met, in place of buffers of all values that grow as they are
    shuffled. Rows without a value are kept and have no weight.
    """
    n = F.when(F.col(value).isNotNull(), F.col(weight)).otherwise(0)
    rows = Window.partitionBy(*keys)
    counted = table.withColumn("__upto", F.sum(n).over(
        rows.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("__all", F.sum(n).over(rows))

    def holds(place: Column) -> Column:
        return F.when((F.col("__upto") > place) & (F.col("__upto") - n <= place), F.col(value).cast("double"))

    last = F.col("__all") - 1
    return counted.withColumn("__low", holds(F.floor(last / 2))).withColumn(
        "__high", holds(F.ceil(last / 2))).drop("__upto", "__all")


def middle() -> Column:
    """Aggregate of rows marked by ``with_middle``: their weighted median."""
    return (F.max("__low") + F.max("__high")) / 2


def hashed_rank(table: DataFrame, identity: str, salt: str, group: Sequence[str] = (),
                rank: str = "rank", size: str = "group_size") -> DataFrame:
    """Global row number within ``group`` in order of ``md5(salt|identity)``, plus group size.

    Hash prefixes spread every group, hot ones included, evenly over 4096 window partitions.
    """
    group = list(group)
    digest = F.md5(F.concat(F.lit(f"{salt}|"), F.col(identity).cast("string")))
    hashed = (table.withColumn("__md5", digest)
              .withColumn("__prefix", F.substring("__md5", 1, HASH_DIGITS)))
    counts = hashed.groupBy(*group, "__prefix").agg(F.count(F.lit(1)).alias("__c"))
    # The constant keeps the window spec valid without groups; at most 16**HASH_DIGITS rows each.
    whole = Window.partitionBy(*group, F.lit(0))
    offsets = counts.select(
        *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)],
        F.col("__prefix").alias("__p"),
        F.coalesce(F.sum("__c").over(whole.orderBy("__prefix").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.sum("__c").over(whole).alias(size))
    matches = F.col("__prefix") == F.col("__p")
    for i, g in enumerate(group):
        matches = matches & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    inside = Window.partitionBy(*group, "__prefix").orderBy("__md5", identity)
    return (hashed.join(offsets, matches)
            .withColumn(rank, (F.row_number().over(inside) + F.col("__before")).cast("bigint"))
            .drop("__md5", "__prefix", "__p", "__before", *[f"__g{i}" for i in range(len(group))]))


def value_rank(table: DataFrame, value: str, identity: str, salt: str,
               rank: str = "rank") -> DataFrame:
    """Row number 1..n over the table by ``value``, ties in order of ``md5(salt|identity)``."""
    digest = F.md5(F.concat(F.lit(f"{salt}|"), F.col(identity).cast("string")))
    hashed = (table.withColumn("__md5", digest)
              .withColumn("__prefix", F.substring("__md5", 1, HASH_DIGITS)))
    # values and hash ranges are placed together, so rows move once and a hot value is spread over its ranges
    counts = hashed.groupBy(F.col(value).alias("__v"), F.col("__prefix").alias("__p")).agg(
        F.count(F.lit(1)).alias("__n"))
    starts = running_totals(counts, "__v", {"__cum": "__n"}, then=["__p"]).select(
        "__v", "__p", (F.col("__cum") - F.col("__n")).alias("__start"))
    inside = Window.partitionBy(value, "__prefix").orderBy("__md5", identity)
    return (hashed.join(starts, (F.col(value) == F.col("__v")) & (F.col("__prefix") == F.col("__p")))
            .withColumn(rank, (F.row_number().over(inside) + F.col("__start")).cast("bigint"))
            .drop("__md5", "__prefix", "__v", "__p", "__start"))


def share_at_or_below(rows: DataFrame, fitted: DataFrame, identity: str,
                      metrics: Sequence[str]) -> DataFrame:
    """Share of ``fitted`` values <= each row's value, per metric: identity + one column each.

    All metrics travel as one long table, so one pass ranks every distribution.
    """
    def long(table: DataFrame, keys: Sequence[str]) -> DataFrame:
        pairs = ", ".join(f"'{m}', cast({m} as double)" for m in metrics)
        return table.selectExpr(*keys, f"stack({len(metrics)}, {pairs}) as (metric, value)")

    wanted = long(rows, [identity])
    both = (long(fitted, []).withColumn("w", F.lit(1).cast("bigint"))
            .unionByName(wanted.select("metric", "value").withColumn("w", F.lit(0).cast("bigint"))))
    counts = both.groupBy("metric", "value").agg(F.sum("w").alias("n"))
    sizes = counts.groupBy("metric").agg(F.sum("n").alias("total"))
    ranked = running_totals(counts, "value", {"at_most": "n"}, ["metric"])
    shares = ranked.join(F.broadcast(sizes), "metric").select(
        "metric", "value", (F.col("at_most") / F.col("total")).alias("share"))
    scored = wanted.join(shares, ["metric", "value"])
    return scored.groupBy(identity).agg(
        *[F.max(F.when(F.col("metric") == m, F.col("share"))).alias(m) for m in metrics])
