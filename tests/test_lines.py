"""Contracts, cleaning flags, thresholds."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from basketlake.operators import cleaning
from basketlake.settings import CleaningSettings
from basketlake.sources import contracts, sinks


def test_duplicates_flags_and_summary(make_lines):
    row = ("1", "A", " red  cup ", 2, "2021-01-01", 3, "X", "Spain")
    lines = make_lines([row, row, ("c2", "A", "  ", -1, "2021-01-02", 3, "X", "Spain"),
                        ("3", " post ", "p", 1, "2021-01-03", 3, None, "Spain"),
                        ("4", "test9", None, 1, "2021-01-03", 0, None, "Spain"),
                        ("5", "A", "big", 200_000, "2021-01-03", 1, "Y", "Spain")])
    table = cleaning.clean(lines)
    got = {r.invoice: r for r in table.collect()}
    assert len(got) == 5 and table.count() == 5
    assert got["1"].description_normalized == "RED CUP" and got["c2"].description_normalized is None
    assert got["c2"].is_cancelled_invoice and got["c2"].is_return and got["c2"].is_valid_merchandise
    assert not got["c2"].is_positive_purchase
    assert float(got["c2"].signed_merchandise_value) == -3 and got["c2"].gross_positive_value == 0
    assert got["3"].is_administrative_line and got["4"].is_administrative_line
    assert got["4"].is_non_positive_price and got["4"].is_missing_customer_id
    assert got["5"].is_likely_data_error and not got["5"].is_valid_merchandise
    summary = cleaning.cleaning_summary(lines, table).first()
    assert (summary.input_rows, summary.output_rows, summary.exact_duplicates_removed) == (6, 5, 1)
    bad = cleaning.clean_violations(table, lines.columns).where("failures > 0").count()
    assert bad == 0


def test_thresholds_ignore_other_customers(spark, sample, make_lines):
    ids = spark.createDataFrame([("CUST0",), ("CUST1",)], "customer_id string")
    before = cleaning.outlier_thresholds(sample, ids).first()
    attack = sample.withColumn("quantity", F.when(
        F.col("customer_id").isin("CUST0", "CUST1"), F.col("quantity")).otherwise(99_999))
    assert cleaning.outlier_thresholds(attack, ids).first() == before
    flagged = cleaning.clean(attack, thresholds=cleaning.outlier_thresholds(sample, ids))
    assert flagged.where("quantity = 99999 and not is_statistical_outlier").count() == 0


def test_domain_limits_are_settings(sample):
    tight = cleaning.clean(sample, CleaningSettings(quantity_limit=1))
    assert tight.where("abs(quantity) > 1 and is_valid_merchandise").count() == 0


def test_csv_part_round_trip(spark, sample, tmp_path):
    raw = sample.select(*[F.col(c).alias(r) for r, c in contracts.CANONICAL_NAMES.items()])
    path = str(tmp_path / "part")
    raw.withColumn("InvoiceDate", F.col("InvoiceDate").cast("string")).write.option(
        "header", True).csv(path)
    loaded = contracts.load_parts(spark, {"one": (path, "csv")}, {"one": sample.count()})
    trimmed = sample.withColumn("description", F.trim("description"))
    assert sinks.fingerprint(loaded).first() == sinks.fingerprint(trimmed).first()
    with pytest.raises(contracts.ContractError):
        contracts.load_parts(spark, {"one": (path, "csv")}, {"one": 1})
    with pytest.raises(contracts.ContractError):
        wrong = str(tmp_path / "wrong")
        raw.drop("Country").write.parquet(wrong)
        contracts.load_parts(spark, {"two": (wrong, "parquet")})


def test_fractional_quantity_is_refused(spark, sample):
    raw = sample.limit(3).select(*[F.col(c).cast("string").alias(r)
                                   for r, c in contracts.CANONICAL_NAMES.items()])
    with pytest.raises(Exception, match="not a whole number"):
        contracts.canonicalize(raw.withColumn("Quantity", F.lit("1.5"))).collect()


def test_batch_upload_rules(spark):
    def upload(*rows):
        return spark.createDataFrame(rows, ", ".join(
            f"{c} string" for c in contracts.CANONICAL_COLUMNS))

    good = ("1", "A", "x", "2", "2021-01-01", "3.5", "X", "Spain")
    assert contracts.validate_batch(upload(good)).first().quantity == 2
    bad = {r.rule: r.failures for r in contracts.batch_violations(upload(
        good, ("1", "A", "x", "two", "2021-01-01", "3.5", "X", "Spain"),
        ("1", "A", "x", "2", "2021-01-01", "NaN", "X", "Spain")), 2).collect()}
    assert bad == {"columns": 0, "empty": 0, "row_limit": 1, "required_values": 1, "finite_price": 1}
    with pytest.raises(contracts.ContractError):
        contracts.validate_batch(upload(good).drop("country"))


def test_fingerprint_ignores_order_but_not_copies(sample):
    once = sinks.fingerprint(sample).first()
    assert sinks.fingerprint(sample.orderBy(F.desc("invoice"))).first() == once
    assert sinks.fingerprint(sample.unionByName(sample)).first() != once
