"""Labels, splits, features and sequences against goldens, brute force and leakage attacks."""

from __future__ import annotations

import hashlib
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketlake.functions import distributed
from basketlake.operators import (
    cleaning, features, products, rolling, sequences, snapshots)
from basketlake.session import materialize
from basketlake.settings import RollingSettings, SequenceSettings, SnapshotSettings
from basketlake.sources import sinks
from tests.conftest import sample_rows

CUT = "2021-04-20 00:00:00"


@pytest.fixture(scope="module")
def clean(sample):
    return cleaning.clean(sample)


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(f"CUST{c}",) for c in range(8)], "customer_id string")


@pytest.fixture(scope="module")
def taxonomy(spark):
    return spark.createDataFrame([(f"P{i:02d}", i % 3) for i in range(11)],
                                 "stock_code string, category_id int")


def same(a, b):
    return sinks.fingerprint(a).first() == sinks.fingerprint(b).first()


def build(clean, people, taxonomy, training=None):
    training = training if training is not None else people.limit(8)
    past = products.training_history(clean, training, CUT)
    return features.customer_features(
        clean, people, CUT, taxonomy, 3, products.reference_prices(past),
        products.popularity(past), training)


def test_cutoffs_and_closed_window(make_lines, spark):
    lines = cleaning.clean(make_lines([
        ("1", "A", "a", 1, "2021-01-01", 5, "X", "S"), ("2", "A", "a", 1, "2021-04-01", 5, "X", "S"),
        ("3", "A", "a", 3, "2021-06-30", 5, "X", "S"), ("C4", "A", "a", -1, "2021-06-30", 5, "X", "S"),
        ("5", "A", "a", 1, "2021-01-01", 5, "Y", "S")]))
    cut = snapshots.canonical_cutoffs(lines).first()
    assert cut.churn_cutoff == datetime(2021, 4, 1) and cut.clv_cutoff == datetime(2021, 1, 1)
    who = spark.createDataFrame([("X",), ("Y",)], "customer_id string")
    labels = {r.customer_id: r.churn for r in
              snapshots.churn_labels(lines, who, "2021-04-01 00:00:00").collect()}
    assert labels == {"X": 0, "Y": 1}
    values = {r.customer_id: r.clv_180d_target for r in
              snapshots.clv_targets(lines, who, "2021-01-01 00:00:00").collect()}
    assert values == {"X": 5 + 5 + 15 - 5, "Y": 5}
    with pytest.raises(ValueError):
        snapshots.canonical_cutoffs(lines, SnapshotSettings(churn_days=180, clv_days=90))


def test_split_is_exact_and_repeatable(spark):
    who = spark.range(1000).select(F.col("id").cast("string").alias("customer_id"))
    split = snapshots.split_customers(who)
    sizes = {r.partition: r["count"] for r in split.groupBy("partition").count().collect()}
    assert sizes == {"train": 700, "validation": 150, "test": 150}
    again = snapshots.split_customers(who.orderBy(F.desc("customer_id")))
    assert same(split, again)
    assert snapshots.split_violations(split).where("failures > 0").count() == 0
    broken = split.unionByName(split.limit(1)).withColumn("partition", F.lit("train"))
    found = {r.rule: r.failures for r in snapshots.split_violations(broken).collect()}
    assert found["repeated_customer"] == 1 and found["absent_partition"] == 2


def test_order_statistics_match_numpy_with_hot_values(spark):
    rng = np.random.default_rng(3)
    values = np.where(rng.random(4000) < 0.4, 0.0, np.round(rng.gamma(2, 50, 4000), 1))
    frame = spark.createDataFrame([(str(i), float(v)) for i, v in enumerate(values)],
                                  "customer_id string, v double")
    got = distributed.exact_quantiles(frame, "v", {"a": 0.1, "b": 0.5, "c": 0.99}).first()
    assert np.allclose(list(got), np.quantile(values, [0.1, 0.5, 0.99]))
    ranked = distributed.value_rank(frame, "v", "customer_id", "s").orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == list(range(1, 4001))
    assert all(a.v <= b.v for a, b in zip(ranked, ranked[1:]))
    shares = {r.customer_id: r.v for r in distributed.share_at_or_below(
        frame, frame, "customer_id", ["v"]).collect()}
    for i in (0, 17, 399):
        assert shares[str(i)] == pytest.approx((values <= values[i]).mean())


def test_features_of_one_customer_by_hand(clean, people, taxonomy):
    table = build(clean, people, taxonomy)
    row = table.where("customer_id = 'CUST0'").first()
    mine = [r for r in sample_rows() if r[6] == "CUST0" and r[4] < datetime(2021, 4, 20)]
    bought = [r for r in mine if r[3] > 0]
    orders = sorted({r[0]: r[4] for r in bought}.values())
    assert row.frequency_orders == len(orders)
    assert row.gross_spend == pytest.approx(sum(r[3] * r[5] for r in bought))
    assert row.net_spend == pytest.approx(sum(r[3] * r[5] for r in mine))
    assert row.recency_days == pytest.approx((datetime(2021, 4, 20) - orders[-1]).total_seconds() / 86400)
    assert row.mean_interpurchase_gap_days == pytest.approx(25.0)
    assert row.variance_interpurchase_gap_days == pytest.approx(0.0)
    assert row.return_rate == pytest.approx(2 / sum(r[3] for r in bought))
    weeks = np.zeros(13)
    for t in orders:
        back = (t - datetime(2021, 1, 20)).total_seconds()
        if back >= 0:
            weeks[min(int(back // 604800), 12)] += 1
    x = np.arange(13) - 6.0
    assert row.purchase_frequency_trend == pytest.approx((x @ (weeks - weeks.mean())) / (x @ x))
    names = features.affinity_columns(3)
    numeric = [c for c, t in table.dtypes if t in ("double", "bigint")]
    assert features.feature_violations(table, people, numeric, names).where(
        "failures > 0").count() == 0


def test_future_and_untrained_rows_do_not_leak(sample, clean, people, taxonomy, spark):
    training = spark.createDataFrame([("CUST0",), ("CUST1",), ("CUST2",)], "customer_id string")
    base = build(clean, people, taxonomy, training)
    future = cleaning.clean(sample.withColumn("quantity", F.when(
        F.col("invoice_date") >= F.lit(CUT).cast("timestamp_ntz"), F.col("quantity") * 50)
        .otherwise(F.col("quantity"))))
    columns = sorted(base.columns)
    assert same(base.select(columns), build(future, people, taxonomy, training).select(columns))
    others = cleaning.clean(sample.withColumn("price", F.when(
        F.col("customer_id").isin("CUST0", "CUST1", "CUST2"), F.col("price"))
        .otherwise((F.col("price") * 9).cast("decimal(18,4)"))))
    for fit in (products.reference_prices, products.popularity, products.modal_descriptions):
        first = fit(products.training_history(clean, training, CUT))
        second = fit(products.training_history(others, training, CUT))
        assert same(first, second)


def test_previous_order_crosses_months(make_lines):
    rows = [(str(i), "A", "a", 1, d, 1, "X", "S") for i, d in enumerate(
        ["2021-01-05", "2021-01-05", "2021-01-31", "2021-03-02", "2021-03-02 12:00:00"])]
    order_rows = features.orders(features.baskets(cleaning.clean(make_lines(rows))))
    got = features.with_previous_order(order_rows).orderBy("event_rank").collect()
    assert [r.event_rank for r in got] == [1, 2, 3, 4, 5]
    assert [r.invoice for r in got] == ["0", "1", "2", "3", "4"]
    assert got[0].previous_date is None
    assert [r.previous_date for r in got[1:]] == [r.invoice_date for r in got[:-1]]


def test_rolling_dataset_matches_single_cutoffs(sample, clean, people, spark):
    cfg = RollingSettings(horizon_days=30, initial_history_days=40, min_history_days=20,
                          high_value=30.0)
    split = people.withColumn("partition", F.when(F.col("customer_id") == "CUST7", "test")
                              .when(F.col("customer_id") == "CUST6", "validation")
                              .otherwise("train"))
    dataset = rolling.rolling_dataset(clean, split, cfg)
    assert rolling.leakage_audit(dataset, split).where("failures > 0").count() == 0
    assert dataset.where("customer_id = 'CUST7'").count() == 0
    cutoffs = [r[0] for r in dataset.select("cutoff_timestamp").distinct().collect()]
    assert len(cutoffs) >= 2
    for cutoff in cutoffs:
        here = dataset.where(F.col("cutoff_timestamp") == F.lit(cutoff)).select(
            "customer_id", *[F.round(c, 6).alias(c) for c in rolling.CLV_FEATURES])
        alone = rolling.clv_features_at(clean, here.select("customer_id"), str(cutoff), cfg).select(
            "customer_id", *[F.round(c, 6).alias(c) for c in rolling.CLV_FEATURES])
        assert same(here, alone)


def test_value_rank_spreads_a_hot_value(spark):
    rows = materialize(spark.range(4000).select(F.col("id").cast("string").alias("k"), F.when(
        F.col("id") % 3 > 0, 0.0).otherwise(F.col("id") % 50 - 25.5).alias("v")))
    ranked = distributed.value_rank(rows, "v", "k", "42")
    assert ranked._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 2  # offsets, and these to the rows
    want = sorted(rows.collect(), key=lambda r: (r.v, hashlib.md5(f"42|{r.k}".encode()).hexdigest(), r.k))
    got = {r.k: r["rank"] for r in ranked.collect()}
    assert got == {r.k: i + 1 for i, r in enumerate(want)}


def test_rolling_inputs_shuffle_lines_and_orders_once(clean, spark):
    at = spark.sql("select array(timestamp_ntz'2021-03-01', timestamp_ntz'2021-04-01') as c").select("c").scalar()
    table = rolling.clv_features(materialize(clean), at)
    plan = table._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan
    assert table._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2


def test_empty_windows_and_split_invoices(make_lines, spark):
    lines = cleaning.clean(make_lines([
        ("1", "P1", "a", 2, "2021-01-10", 10, "A", "S"), ("1", "P2", "a", 1, "2021-01-12", 5, "A", "S"),
        ("C2", "P1", "a", -1, "2021-01-20", 10, "A", "S"), ("3", "P1", "a", 1, "2022-03-31 23:00:00", 7, "A", "S")]))
    at = spark.sql("select sequence(timestamp_ntz'2021-02-01', timestamp_ntz'2022-05-01', interval 1 month) as c"
                   ).select("c").scalar()
    rows = {str(r.cutoff_timestamp)[:7]: r for r in rolling.clv_features(lines, at).collect()}
    assert len(rows) == 16
    first, quiet, last = rows["2021-02"], rows["2021-12"], rows["2022-04"]
    assert (first.spend_30d, first.orders_30d, first.customer_tenure_days) == (25.0, 1.0, 22.0)
    assert first.return_value_ratio == pytest.approx(10 / 25) and first.lifetime_net_revenue == 15.0
    assert (quiet.spend_180d, quiet.orders_180d, quiet.active_month_count, quiet.return_value_ratio) == (0, 0, 0, 0)
    assert (quiet.lifetime_orders, quiet.lifetime_positive_spend, quiet.lifetime_net_revenue) == (1, 25.0, 15.0)
    assert (last.lifetime_orders, last.spend_30d, last.lifetime_net_revenue) == (2, 7.0, 22.0)
    assert str(last.feature_max_timestamp) == "2022-03-31 23:00:00"


def test_sequences_stay_bounded_and_ordered(clean, people, taxonomy):
    split = people.withColumn("partition", F.lit("train"))
    events = sequences.invoice_events(clean, taxonomy)
    cfg = SequenceSettings(length=3, max_snapshots=2)
    end = snapshots.canonical_cutoffs(clean).select("observation_end").scalar()
    table = sequences.rolling_sequences(events, split, end, cfg)
    rows = table.collect()
    assert rows and max(r.length for r in rows) == 3
    for r in rows:
        ranks = [e.event_rank for e in r.events]
        assert ranks == sorted(ranks) and ranks[-1] == r.history_end
    padded = sequences.padded(table, sequences.scaler(table), 3).collect()
    assert all(len(r.amounts) == len(r.gaps) == len(r.categories) == 3 for r in padded)


def test_next_category_ties(make_lines, spark):
    lines = cleaning.clean(make_lines([
        ("1", "P1", "a", 1, "2021-02-01", 10, "A", "S"), ("1", "P2", "a", 2, "2021-02-01", 5, "A", "S"),
        ("2", "P1", "a", 9, "2021-03-01", 10, "A", "S"), ("3", "ZZ", "a", 1, "2021-02-02", 1, "B", "S"),
        ("4", "P1", "a", 1, "2021-01-01", 1, "B", "S")]))
    known = spark.createDataFrame([("P1", 2), ("P2", 4)], "stock_code string, category_id int")
    got = {r.customer_id: r.next_category_id for r in
           sequences.next_category(lines, known, "2021-01-15 00:00:00").collect()}
    assert got == {"A": 4, "B": -1}
