"""Sources, sinks and cleaning as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketlake.functions.columns import is_administrative, r6, upper_collapsed
from basketlake.functions.timing import stamp
from basketlake.operators import cleaning
from basketlake.plans.catalogue.registry import block, clean_sql, query
from basketlake.sources import contracts, sinks

# --- sources ------------------------------------------------------------------------------------
_LINE_COLUMNS = """invoice, stock_code, NULLIF(trim(description), '') AS description, quantity,
strftime(invoice_date, '%Y-%m-%d %H:%M:%S') AS invoice_date, CAST(price AS DOUBLE) AS price,
customer_id, country"""


def _raw(lines):
    """Canonical lines under the names of the source contract."""
    return lines.select(*[F.col(canonical).alias(raw)
                          for raw, canonical in contracts.CANONICAL_NAMES.items()])


def _shown(lines):
    return lines.select("invoice", "stock_code", "description", "quantity",
                        stamp(F.col("invoice_date")).alias("invoice_date"),
                        F.col("price").cast("double").alias("price"), "customer_id", "country")


def _parts(ws):
    """Two source parts on disk, an older CSV one and a newer Parquet one; written once."""
    paths = {"older": (f"{ws.root}/source_older", "csv"), "newer": (f"{ws.root}/source_newer", "parquet")}
    if not ws.__dict__.get("_parts_written"):
        raw = _raw(ws.lines)
        edge = F.lit("1998-01-01").cast("timestamp_ntz")
        (raw.where(F.col("InvoiceDate") < edge)
         .withColumn("InvoiceDate", stamp(F.col("InvoiceDate")))
         .write.mode("overwrite").option("header", True).option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
         .csv(paths["older"][0]))
        raw.where(F.col("InvoiceDate") >= edge).write.mode("overwrite").parquet(paths["newer"][0])
        ws.__dict__["_parts_written"] = True
    return paths


@query("a1_load_transactions", f"SELECT {_LINE_COLUMNS} FROM canonical")
def load(ws):
    return _shown(contracts.load_parts(ws.spark, _parts(ws)))


@query("a2_normalize_source", f"SELECT {_LINE_COLUMNS} FROM canonical")
def normalize(ws):
    return _shown(contracts.canonicalize(_raw(ws.lines)))


@query("a3_source_contract", """
SELECT part, CAST(0 AS BIGINT) AS wrong_columns, n_rows,
       CAST(CASE part WHEN 'older' THEN abs(n_rows - 1000) ELSE 0 END AS BIGINT) AS row_count_gap
FROM (SELECT CASE WHEN invoice_date < TIMESTAMP '1998-01-01' THEN 'older' ELSE 'newer' END AS part,
             count(*) AS n_rows FROM canonical GROUP BY 1)""")
def source_contract(ws):
    parts = {name: contracts.read_part(ws.spark, path, fmt)
             for name, (path, fmt) in _parts(ws).items()}
    return contracts.source_violations(parts, {"older": 1000})


@query("a4_canonical_schema", """
SELECT 'columns' AS rule, 'table' AS subject, CAST(0 AS BIGINT) AS failures
UNION ALL SELECT 'type', unnest(['invoice', 'stock_code', 'description', 'quantity', 'invoice_date',
                                 'price', 'customer_id', 'country']), 0
UNION ALL SELECT 'not_null', 'invoice', count(*) FILTER (invoice IS NULL) FROM canonical
UNION ALL SELECT 'not_null', 'stock_code', count(*) FILTER (stock_code IS NULL) FROM canonical
UNION ALL SELECT 'not_null', 'quantity', count(*) FILTER (quantity IS NULL) FROM canonical
UNION ALL SELECT 'not_null', 'invoice_date', count(*) FILTER (invoice_date IS NULL) FROM canonical
UNION ALL SELECT 'not_null', 'price', count(*) FILTER (price IS NULL) FROM canonical
UNION ALL SELECT 'not_null', 'country', count(*) FILTER (country IS NULL) FROM canonical""")
def canonical_schema(ws):
    return contracts.schema_violations(ws.lines)


block("null_shares", """
SELECT avg(CASE WHEN invoice IS NULL THEN 1.0 ELSE 0.0 END) AS a,
       avg(CASE WHEN stock_code IS NULL THEN 1.0 ELSE 0.0 END) AS b,
       avg(CASE WHEN NULLIF(trim(description), '') IS NULL THEN 1.0 ELSE 0.0 END) AS c,
       avg(CASE WHEN quantity IS NULL THEN 1.0 ELSE 0.0 END) AS d,
       avg(CASE WHEN invoice_date IS NULL THEN 1.0 ELSE 0.0 END) AS e,
       avg(CASE WHEN price IS NULL THEN 1.0 ELSE 0.0 END) AS f,
       avg(CASE WHEN customer_id IS NULL THEN 1.0 ELSE 0.0 END) AS g,
       avg(CASE WHEN country IS NULL THEN 1.0 ELSE 0.0 END) AS h FROM canonical""")


@query("a5_null_rates", """
SELECT column_name, round(CAST(rate AS DOUBLE), 6) AS null_rate, max_rate, rate <= max_rate AS within_limit
FROM (SELECT 'invoice' AS column_name, a AS rate, CAST(0 AS DOUBLE) AS max_rate FROM null_shares
      UNION ALL SELECT 'stock_code', b, 0 FROM null_shares
      UNION ALL SELECT 'description', c, 0.01 FROM null_shares
      UNION ALL SELECT 'quantity', d, 0 FROM null_shares
      UNION ALL SELECT 'invoice_date', e, 0 FROM null_shares
      UNION ALL SELECT 'price', f, 0 FROM null_shares
      UNION ALL SELECT 'customer_id', g, 0.30 FROM null_shares
      UNION ALL SELECT 'country', h, 0 FROM null_shares)""")
def null_rates(ws):
    lines = contracts.canonicalize(_raw(ws.lines))
    return contracts.null_rates(lines).withColumn("null_rate", r6(F.col("null_rate")))


@query("a6_date_range", """
SELECT strftime(min(invoice_date), '%Y-%m-%d %H:%M:%S') AS first_seen,
       strftime(max(invoice_date), '%Y-%m-%d %H:%M:%S') AS last_seen, count(*) AS n_rows,
       min(invoice_date) = TIMESTAMP '1995-01-01' AND max(invoice_date) = TIMESTAMP '2001-08-01'
         AS range_ok FROM canonical""")
def date_range(ws):
    seen = contracts.date_range(ws.lines, "1995-01-01", "2001-08-01")
    return seen.withColumns({"first_seen": stamp(F.col("first_seen")),
                             "last_seen": stamp(F.col("last_seen"))})


@query("a7_batch_validation", """
SELECT 'columns' AS rule, CAST(0 AS BIGINT) AS failures
UNION ALL SELECT 'empty', 0
UNION ALL SELECT 'row_limit', greatest(count(*) - 50000, 0) FROM canonical
UNION ALL SELECT 'required_values', count(*) FILTER (
    customer_id IS NULL OR stock_code = 'POST' OR country = 'NATION_3') FROM canonical
UNION ALL SELECT 'finite_price', count(*) FILTER (country = 'NATION_4' AND stock_code <> 'POST'
    ) FROM canonical""")
def batch_validation(ws):
    # An upload is text; some of it does not parse, some prices are not finite.
    price = (F.when(F.col("country") == "NATION_3", "free")
             .when((F.col("country") == "NATION_4") & (F.col("stock_code") != "POST"), "NaN")
             .otherwise(F.col("price").cast("string")))
    upload = ws.lines.select(
        "invoice", "stock_code", "description",
        F.when(F.col("stock_code") == "POST", "some").otherwise(F.col("quantity").cast("string"))
        .alias("quantity"), stamp(F.col("invoice_date")).alias("invoice_date"),
        price.alias("price"), "customer_id", "country")
    return contracts.batch_violations(upload, 50_000).select("rule", "failures")


@query("a8_parquet_sinks", """
SELECT count(*) AS n_rows, 'transactions_clean' AS table_name FROM cleaned
UNION ALL SELECT count(*), 'outlier_audit' FROM fitted WHERE is_statistical_outlier
UNION ALL SELECT count(*), 'customer_split' FROM split_table
UNION ALL SELECT count(*), 'customer_features_churn' FROM feature_base JOIN split_table USING (customer_id)
UNION ALL SELECT count(*), 'customer_features_clv' FROM split_table
UNION ALL SELECT count(*), 'product_taxonomy' FROM catalogue
UNION ALL SELECT count(*), 'product_reference_prices' FROM prices
UNION ALL SELECT count(*), 'product_frequency_encoding' FROM popular""")
def parquet_sinks(ws):
    tables = {
        "transactions_clean": ws.clean, "outlier_audit": _fitted(ws).where("is_statistical_outlier"),
        "customer_split": ws.split, "customer_features_churn": ws.churn_table,
        "customer_features_clv": ws.clv_table, "product_taxonomy": ws.taxonomy,
        "product_reference_prices": ws.prices, "product_frequency_encoding": ws.popular}
    paths = sinks.write_tables(tables, f"{ws.root}/outputs")
    counts = [ws.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_rows"))
              .withColumn("table_name", F.lit(name)) for name, path in paths.items()]
    total = counts[0]
    for one in counts[1:]:
        total = total.unionByName(one)
    return total


@query("a9_csv_evidence", """
SELECT stock_code, printf('%#.10g', reference_price) AS reference_price,
       CAST(reference_observations AS VARCHAR) AS reference_observations FROM prices""")
def csv_evidence(ws):
    path = sinks.write_csv(ws.prices, f"{ws.root}/evidence/reference_prices")
    return ws.spark.read.option("header", True).csv(path)


@query("a10_table_fingerprint")
def table_fingerprint(ws):
    tables = {"clean": ws.clean, "split": ws.split, "churn_features": ws.churn_features,
              "clv_features": ws.clv_features, "taxonomy": ws.taxonomy}
    total = None
    for name, frame in tables.items():
        row = sinks.fingerprint(frame).withColumn("table_name", F.lit(name))
        total = row if total is None else total.unionByName(row)
    return total


@query("a10_fingerprint_properties", """
SELECT 'clean' AS table_name, count(*) AS n_rows, TRUE AS same_again, TRUE AS changed_by_one_row FROM cleaned
UNION ALL SELECT 'split', count(*), TRUE, TRUE FROM split_table
UNION ALL SELECT 'taxonomy', count(*), TRUE, TRUE FROM catalogue""")
def fingerprint_properties(ws):
    """The hash of a table dealt anew is the same; with one of its rows more it is another."""
    total = None
    for name, frame in {"clean": ws.clean, "split": ws.split, "taxonomy": ws.taxonomy}.items():
        def printed(rows, suffix):
            row = sinks.fingerprint(rows)
            return row.select(*[F.col(c).alias(f"{c}_{suffix}") for c in row.columns], F.lit(name).alias("table_name"))
        three = printed(frame, "a").join(printed(frame.repartition(7), "b"), "table_name").join(
            printed(frame.unionByName(frame.limit(1)), "c"), "table_name")
        rows = three.select(
            "table_name", F.col("n_rows_a").alias("n_rows"),
            ((F.col("xor_hash_a") == F.col("xor_hash_b")) & (F.col("sum_hash_a") == F.col("sum_hash_b"))).alias("same_again"),
            (F.col("sum_hash_a") != F.col("sum_hash_c")).alias("changed_by_one_row"))
        total = rows if total is None else total.unionByName(rows)
    return total


@query("a11_run_metadata", """
SELECT 'clean_rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM cleaned
UNION ALL SELECT 'customers', CAST(count(*) AS DOUBLE) FROM population
UNION ALL SELECT 'customers_' || partition_name, CAST(count(*) AS DOUBLE)
  FROM split_table GROUP BY partition_name
UNION ALL SELECT 'reference_price_products', CAST(count(*) AS DOUBLE) FROM prices
UNION ALL SELECT 'frequency_encoded_products', CAST(count(*) AS DOUBLE) FROM popular
UNION ALL SELECT 'churn_rate', round(avg(churn), 6) FROM churn_flags
UNION ALL SELECT 'clv_positive_rate', round(avg(CASE WHEN clv_180d_target > 0 THEN 1.0 ELSE 0.0 END), 6)
  FROM clv_values""")
def run_metadata(ws):
    def metric(frame, name, value):
        return frame.agg(value.cast("double").alias("value")).select(
            F.lit(name).alias("metric"), "value")

    rows = F.count(F.lit(1))
    total = metric(ws.clean, "clean_rows", rows)
    for part in (
            metric(ws.customers, "customers", rows),
            ws.split.groupBy("partition").agg(rows.cast("double").alias("value")).select(
                F.concat(F.lit("customers_"), "partition").alias("metric"), "value"),
            metric(ws.prices, "reference_price_products", rows),
            metric(ws.popular, "frequency_encoded_products", rows),
            metric(ws.churn_table, "churn_rate", r6(F.avg("churn"))),
            metric(ws.clv_table, "clv_positive_rate",
                   r6(F.avg((F.col("clv_180d_target") > 0).cast("double"))))):
        total = total.unionByName(part)
    return total


# --- cleaning -----------------------------------------------------------------------------------
@query("b1_exact_duplicates", """
SELECT (SELECT count(*) FROM copied) AS input_rows,
       (SELECT count(*) FROM (SELECT DISTINCT * FROM copied)) AS output_rows,
       (SELECT count(*) FROM copied) - (SELECT count(*) FROM (SELECT DISTINCT * FROM copied))
         AS exact_duplicates_removed""")
def exact_duplicates(ws):
    kept = cleaning.without_duplicates(ws.lines_with_copies).agg(
        F.count(F.lit(1)).alias("output_rows"))
    total = ws.lines_with_copies.agg(F.count(F.lit(1)).alias("n")).scalar()
    return kept.withColumn("input_rows", total).withColumn(
        "exact_duplicates_removed", F.col("input_rows") - F.col("output_rows"))


@query("b2_normalize_description", """
SELECT NULLIF(trim(regexp_replace(upper(description), '\\s+', ' ', 'g')), '')
         AS description_normalized, count(*) AS n FROM canonical GROUP BY 1""")
def normalize_description(ws):
    return (ws.lines.groupBy(upper_collapsed(F.col("description")).alias("description_normalized"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("b3_administrative_lines", """
SELECT stock_code, code_form, count(*) AS n,
       upper(trim(code_form)) IN ('POST', 'M', 'D')
         OR regexp_matches(upper(trim(code_form)), '^(TEST|GIFT_)') AS is_administrative
FROM (SELECT stock_code, CASE CAST(quantity % 5 AS INTEGER) WHEN 0 THEN ' ' || lower(stock_code) || ' '
                              WHEN 1 THEN 'test' || stock_code WHEN 2 THEN 'x_GIFT_1'
                              WHEN 3 THEN 'gift_' || stock_code ELSE stock_code END AS code_form
      FROM canonical) GROUP BY ALL""")
def administrative_lines(ws):
    code, q = F.col("stock_code"), F.col("quantity") % 5
    form = (F.when(q == 0, F.concat(F.lit(" "), F.lower(code), F.lit(" ")))
            .when(q == 1, F.concat(F.lit("test"), code)).when(q == 2, "x_GIFT_1")
            .when(q == 3, F.concat(F.lit("gift_"), code)).otherwise(code))
    return (ws.lines.groupBy("stock_code", form.alias("code_form"))
            .agg(F.count(F.lit(1)).alias("n"))
            .withColumn("is_administrative", is_administrative(
                F.col("code_form"), ("POST", "M", "D"), ("^TEST", "^GIFT_"))))


_FLAGS = ("is_missing_customer_id", "is_cancelled_invoice", "is_return", "is_non_positive_price",
          "is_zero_quantity", "is_administrative_line", "is_product")


@query("b4_quality_flags", f"""
SELECT invoice, stock_code, description, quantity, {', '.join(_FLAGS)}, count(*) AS n
FROM cleaned GROUP BY ALL""")
def quality_flags(ws):
    flagged = cleaning.quality_flags(cleaning.without_duplicates(ws.lines))
    return flagged.groupBy("invoice", "stock_code", "description", "quantity", *_FLAGS).agg(
        F.count(F.lit(1)).alias("n"))


block("bounds", """
SELECT q1 - 0.25 * (q3 - q1) AS quantity_lower, q3 + 0.25 * (q3 - q1) AS quantity_upper,
       p1 - 0.25 * (p3 - p1) AS price_lower, p3 + 0.25 * (p3 - p1) AS price_upper
FROM (SELECT quantile_cont(CAST(quantity AS DOUBLE), 0.25) AS q1,
             quantile_cont(CAST(quantity AS DOUBLE), 0.75) AS q3,
             quantile_cont(CAST(price AS DOUBLE), 0.25) FILTER (price > 0) AS p1,
             quantile_cont(CAST(price AS DOUBLE), 0.75) FILTER (price > 0) AS p3 FROM training)""")
block("fitted", clean_sql("canonical", "bounds", 45))


def _thresholds(ws):
    return cleaning.outlier_thresholds(
        ws.clean.where(F.col("invoice_date") < ws.clv_cutoff), ws.training_ids, ws.cleaning_cfg)


def _fitted(ws):
    return cleaning.refitted(ws.clean, ws.cleaning_cfg, _thresholds(ws))


@query("b5_outlier_thresholds", """
SELECT round(quantity_lower, 6) AS quantity_lower, round(quantity_upper, 6) AS quantity_upper,
       round(price_lower, 6) AS price_lower, round(price_upper, 6) AS price_upper FROM bounds""")
def outlier_thresholds(ws):
    fitted = _thresholds(ws)
    return fitted.select(*[r6(F.col(c)).alias(c) for c in fitted.columns])


@query("b6_outlier_flags", """
SELECT quantity, CAST(price AS DOUBLE) AS price, is_quantity_iqr_outlier, is_price_iqr_outlier,
       is_statistical_outlier, is_likely_data_error, count(*) AS n FROM fitted GROUP BY ALL""")
def outlier_flags(ws):
    return _fitted(ws).groupBy(
        "quantity", F.col("price").cast("double").alias("price"), "is_quantity_iqr_outlier",
        "is_price_iqr_outlier", "is_statistical_outlier", "is_likely_data_error").agg(
        F.count(F.lit(1)).alias("n"))


@query("b7_eligibility_flags", """
SELECT invoice, stock_code, quantity, is_valid_merchandise, is_positive_purchase, count(*) AS n
FROM fitted GROUP BY ALL""")
def eligibility_flags(ws):
    return _fitted(ws).groupBy("invoice", "stock_code", "quantity", "is_valid_merchandise",
                               "is_positive_purchase").agg(F.count(F.lit(1)).alias("n"))


@query("b8_line_values", """
SELECT invoice, CAST(sum(signed_merchandise_value) AS DOUBLE) AS signed_value,
       CAST(sum(gross_positive_value) AS DOUBLE) AS gross_value FROM cleaned GROUP BY invoice""")
def line_values(ws):
    return cleaning.clean(ws.lines).groupBy("invoice").agg(
        F.sum("signed_merchandise_value").cast("double").alias("signed_value"),
        F.sum("gross_positive_value").cast("double").alias("gross_value"))


block("fitted_copies", clean_sql("copied", "bounds", 45))


@query("b9_cleaning_summary", """
SELECT (SELECT count(*) FROM copied) AS input_rows,
       (SELECT count(*) FROM copied) - count(*) AS exact_duplicates_removed,
       count(*) AS output_rows, count(*) FILTER (is_missing_customer_id) AS missing_customer_rows,
       count(*) FILTER (is_return) AS return_rows,
       count(*) FILTER (is_cancelled_invoice) AS cancelled_invoice_rows,
       count(*) FILTER (is_non_positive_price) AS non_positive_price_rows,
       count(*) FILTER (is_administrative_line) AS administrative_rows,
       count(*) FILTER (is_statistical_outlier) AS statistical_outlier_rows,
       count(*) FILTER (is_likely_data_error) AS likely_data_error_rows FROM fitted_copies""")
def cleaning_summary(ws):
    source = ws.lines_with_copies
    return cleaning.cleaning_summary(
        source, cleaning.clean(source, ws.cleaning_cfg, _thresholds(ws)))


@query("b10_clean_invariants", """
SELECT 'remaining_duplicates' AS rule, CAST(0 AS BIGINT) AS failures
UNION ALL SELECT 'positive_return', count(*) FILTER (is_positive_purchase AND is_return) FROM cleaned
UNION ALL SELECT 'positive_not_valid', count(*) FILTER (is_positive_purchase AND NOT is_valid_merchandise) FROM cleaned
UNION ALL SELECT 'negative_gross', count(*) FILTER (gross_positive_value < 0) FROM cleaned""")
def clean_invariants(ws):
    source = ws.lines_with_copies
    return cleaning.clean_violations(cleaning.clean(source), source.columns)


