"""Stages move line rows as often as their keys need, and give what the plain operators give."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from basketlake.operators import cleaning, features, products, snapshots
from basketlake.settings import CleaningSettings
from basketlake.sources import adapter

NO_BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}


@pytest.fixture
def shuffled_joins(spark):
    """Joins as at size: no table is small enough to be sent to every task."""
    before = {k: spark.conf.get(k, None) for k in NO_BROADCAST}
    for k, v in NO_BROADCAST.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def exchanges(frame) -> list[str]:
    plan = frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return re.findall(r"Exchange hashpartitioning\(([^\n]*), \d+\)", plan)


@pytest.fixture
def star(spark, tmp_path):
    """Orders with repeated lines, alike lines of other numbers, a part that is not there and a null customer."""
    folder = str(tmp_path)
    lines = [(o, 1 + (o * 3 + k) % 5, k, 5.0 + k % 2, 0.05 if k else 0.0, 0.0, "R" if (o + k) % 3 == 0 else "N")
             for o in range(1, 13) for k in (1, 2, 2, 5, 6, 7)]
    lines += [(3, 9, 1, 4.0, 0.01, 0.02, "N"), (3, 9, 2, 4.0, 0.01, 0.02, "N")]
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, "
                          "l_discount double, l_tax double, l_returnflag string").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(o, 8 + o % 4) for o in range(1, 13)], "o_orderkey bigint, o_custkey bigint").withColumn(
        "o_orderdate", F.expr("timestamp'2021-01-01' + make_dt_interval(cast(o_orderkey * 20 as int))")).write.parquet(
        f"{folder}/orders.parquet")
    spark.createDataFrame([(c, c % 2) for c in range(8, 12)], "c_custkey bigint, c_nationkey int").write.parquet(
        f"{folder}/customer.parquet")
    spark.createDataFrame([(0, "FRANCE"), (1, "SPAIN")], "n_nationkey int, n_name string").write.parquet(
        f"{folder}/nation.parquet")
    spark.createDataFrame([(p, f"part {p}", "SMALL", "B1", 2.5 * p) for p in range(1, 6)],
                          "p_partkey bigint, p_name string, p_type string, p_brand string, p_retailprice double").write.parquet(
        f"{folder}/part.parquet")
    return folder


def test_copies_are_dropped_where_orders_were_joined(spark, star, shuffled_joins):
    every = adapter.canonical_lines(spark, star)
    once = adapter.canonical_lines(spark, star, distinct=True)
    assert once.columns == every.columns
    assert every.count() == 74 and 0 < once.count() < 74
    assert sorted(map(str, once.collect())) == sorted(map(str, every.distinct().collect()))
    # lines move by part and by order; orders and customers move to each other
    assert len(exchanges(once)) == len(exchanges(every)) == 6
    assert len(exchanges(every.distinct())) == 7


def test_refitted_lines_are_those_cleaned_anew(sample):
    cfg = CleaningSettings(quantity_limit=7, iqr_multiplier=0.25)
    limits = cleaning.outlier_thresholds(cleaning.clean(sample), sample.select("customer_id").distinct(), cfg)
    anew = cleaning.clean(sample, cfg, limits)
    again = cleaning.refitted(cleaning.clean(sample), cfg, limits)
    assert again.columns == anew.columns
    assert anew.where("is_statistical_outlier").count() and anew.where("is_likely_data_error").count()
    assert sorted(map(str, again.collect())) == sorted(map(str, anew.collect()))


def test_features_of_some_customers_do_not_move_lines_by_customer(spark, sample, shuffled_joins, monkeypatch):
    lines = cleaning.clean(sample)
    cutoff = F.lit("2021-05-01").cast("timestamp_ntz")
    people = snapshots.eligible_customers(lines, F.lit("2021-01-08").cast("timestamp_ntz"))
    prices, popular = products.reference_prices(lines), products.popularity(lines)
    codes = spark.createDataFrame([("P01", 0), ("P02", 1), ("P05", 1)], "stock_code string, category_id int")
    stored = []
    monkeypatch.setattr(features, "stored", lambda rows: stored.append(rows) or rows)
    whole = features.raw_customer_features(lines, people, cutoff, codes, 2, prices, popular)
    assert len(stored) == 1  # orders are written once
    monkeypatch.undo()
    past = features.customer_history(lines, people, cutoff)
    baskets = features.baskets(past)
    order_rows = features.orders(baskets)
    parts = [features.rfm(order_rows, cutoff), features.variety(baskets), features.net_spend(past),
             features.gaps(order_rows), features.seasonality(order_rows), features.markdown_affinity(baskets, prices),
             features.popularity_mix(baskets, popular), features.category_affinity(baskets, codes, 2)]
    wide = {r.customer_id: r.asDict() for r in whole.collect()}
    assert set(wide) == {r.customer_id for r in people.collect()} and 0 < len(wide) < 8
    for part in parts:
        for r in part.collect():
            for name, value in r.asDict().items():
                assert wide[r.customer_id][name] == (pytest.approx(value) if isinstance(value, float) else value), name


def test_weighted_medians_equal_percentiles(spark):
    from basketlake.functions.distributed import middle, with_middle
    rows = spark.createDataFrame(
        [(k, None if (k * i) % 5 == 4 else float((i * 7 + k) % 6), 1 + (i + k) % 4) for k in range(9) for i in range(k)]
        + [(100, None, 3)], "k int, x double, n bigint")
    got = {r.k: r.m for r in with_middle(rows, ["k"], "x", "n").groupBy("k").agg(middle().alias("m")).collect()}
    want = {r.k: r.m for r in rows.groupBy("k").agg(F.expr("percentile(x, 0.5D, n)").alias("m")).collect()}
    assert got == want and got[100] is None
    plan = with_middle(rows, ["k"], "x", "n").groupBy("k").agg(middle())._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan
