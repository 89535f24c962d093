"""Maps the star-schema test tables onto canonical transaction lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def canonical_lines(spark: SparkSession, folder: str, distinct: bool = False) -> DataFrame:
    """Invoice lines from lineitem, orders, customer, nation and part; ``distinct``: one copy of each.

    Only ``nation`` is hinted for broadcast (25 rows by definition); every other join strategy is
    left to the optimizer's size estimates. Orders are joined last: an invoice names one order key, so
    copies meet where that join put their order key, and dropping them moves no row again.
    """
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount", "l_tax",
        "l_returnflag")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    nations = F.broadcast(table(spark, folder, "nation").select("n_nationkey", "n_name"))
    parts = table(spark, folder, "part").select(
        "p_partkey", "p_name", "p_type", "p_brand", "p_retailprice")
    buyers = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    placed = orders.join(buyers, F.col("o_custkey") == F.col("c_custkey"))

    returned = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") % 2 == 0)
    plain = F.concat_ws(" ", "p_name", "p_type")
    spaced = F.concat(F.lit("  "), F.col("p_name"), F.lit("   "), F.col("p_type"), F.lit(" "))
    described = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left").select(
        "l_orderkey", F.when(returned, "C").otherwise("").alias("prefix"),
        F.when(F.col("l_linenumber") == 7, "POST")
        .otherwise(F.col("l_partkey").cast("string")).alias("stock_code"),
        F.when((F.col("l_linenumber") == 5) & (F.col("l_partkey") % 20 == 0), F.lit("  "))
        .when(F.col("l_linenumber") == 3, spaced)
        .when(F.col("l_linenumber") == 4, F.concat_ws(" ", plain, "p_brand"))
        .otherwise(plain).alias("description"),
        (F.col("l_quantity").cast("bigint") * F.when(returned, -1).otherwise(1)).alias("quantity"),
        F.when((F.col("l_discount") == 0) & (F.col("l_tax") == 0), F.lit(0).cast("decimal(18,4)"))
        .otherwise((F.col("p_retailprice").cast("decimal(18,2)")
                    * (1 - F.col("l_discount")).cast("decimal(4,2)")).cast("decimal(18,4)"))
        .alias("price"))
    joined = described.join(placed, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "prefix", "stock_code", "description", "quantity",
        F.col("o_orderdate").cast("timestamp_ntz").alias("invoice_date"), "price",
        F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey").cast("string"))
        .alias("customer_id"),
        F.col("n_name").alias("country"))
    if distinct:
        joined = joined.distinct()
    return joined.select(
        F.concat("prefix", F.col("l_orderkey").cast("string")).alias("invoice"),
        "stock_code", "description", "quantity", "invoice_date", "price", "customer_id", "country")


# Category numbers of the part types; PROMO stays outside the taxonomy (unknown).
CATALOGUE_TYPES = {"ECONOMY": 0, "LARGE": 1, "MEDIUM": 2, "SMALL": 3, "STANDARD": 4}


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """A ready product taxonomy with one category per part type (an exactly checkable stand-in)."""
    category = F.lit(None).cast("int")
    for name, number in CATALOGUE_TYPES.items():
        category = F.when(F.col("p_type") == name, number).otherwise(category)
    parts = table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("stock_code"), category.alias("category_id"))
    return parts.where(F.col("category_id").isNotNull())
