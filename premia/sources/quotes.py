"""Quote blocks derived from the star-schema test tables.

The quote model needs declined prices, missing deductibles, bad dates and unseen
categories; the formulas below derive them from the keys of the given tables, so the
view grows with the tables. One row per order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from premia.roles import INSURERS, PRICE_COLS, deductible_col, price_col

BLOCKS = ("block1", "block2", "block3")

# Columns the view needs; a given schema saves a pass over the file footers.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_nationkey int, c_mktsegment string",
    "part": "p_partkey long, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_extendedprice double, "
    "l_discount double",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _line_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read_table(spark, sf_dir, "lineitem")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    bucket = F.col("l_suppkey") % len(INSURERS)
    return line.groupBy("l_orderkey").agg(
        F.min("l_partkey").alias("partkey"),
        *[F.min(F.when(bucket == n, net)).alias(price_col(i)) for n, i in enumerate(INSURERS)],
    )


def _day(start: str, offset: Column) -> Column:
    return F.date_add(F.lit(start).cast("date"), offset.cast("int"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quote view: ids, time, block, attributes, deductibles and prices."""
    order = F.col("o_orderkey")
    cust = F.col("c_custkey")
    birth = _day("1925-01-01", (cust * 37) % 31000)
    registered = _day("1990-01-01", (order * 41) % 12000)
    inspected = order % 9 != 0

    rows = (
        read_table(spark, sf_dir, "orders")
        .join(read_table(spark, sf_dir, "customer"), F.col("o_custkey") == cust)
        .join(read_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(read_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .join(_line_prices(spark, sf_dir), F.col("l_orderkey") == order, "left")
        .join(read_table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("partkey"), "left")
    )
    deductibles = [
        F.when((order + n) % 17 != 0, (100 * (1 + (order * 7 + 13 * n) % 10)).cast("double")).alias(
            deductible_col(i)
        )
        for n, i in enumerate(INSURERS)
    ]
    return rows.select(
        order.alias("quote_id"),
        F.col("o_orderdate").alias("quote_ts"),
        F.when(F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz"), "block1")
        .when(F.col("o_orderdate") < F.lit("2001-01-01").cast("timestamp_ntz"), "block2")
        .otherwise("block3")
        .alias("block"),
        F.when(order % 7 == 0, None)
        .when(order % 7 <= 2, "MTPL")
        .when(order % 7 == 3, "Limited Casco")
        .otherwise("Casco")
        .alias("coverage"),
        F.col("o_orderpriority").alias("payment_frequency"),
        F.col("c_mktsegment").alias("usage"),
        birth.alias("contractor_birthdate"),
        F.when(order % 40 == 0, "unknown")
        .when(order % 4 == 0, F.date_format(birth, "dd/MM/yyyy"))
        .alias("second_driver_birthdate"),
        F.when(order % 23 != 0, (cust % 20).cast("double")).alias("claim_free_years"),
        F.when(order % 4 == 0, (cust % 12).cast("double")).alias("second_driver_claim_free_years"),
        registered.alias("vehicle_first_registration_date"),
        F.when(order % 13 != 0, F.date_add(registered, (order % 300).cast("int"))).alias(
            "vehicle_country_first_registration_date"
        ),
        F.date_add(registered, (order % 900).cast("int")).alias("vehicle_last_registration_date"),
        F.when(inspected, _day("2023-06-01", order % 500)).alias("vehicle_inspection_report_date"),
        F.when(inspected, _day("2024-06-01", order % 700)).alias("vehicle_inspection_expiry_date"),
        F.when(inspected, (order % 3).cast("double")).alias(
            "vehicle_inspection_number_of_deficiencies_found"
        ),
        F.col("p_brand").alias("vehicle_maker"),
        F.concat("p_type", F.lit("_"), F.col("p_size").cast("string")).alias("vehicle_model"),
        (F.col("p_size") * 6).cast("double").alias("vehicle_power"),
        (900 + F.col("p_partkey") % 1500).cast("double").alias("vehicle_net_weight"),
        (F.col("p_retailprice") * 30).alias("vehicle_value_new"),
        ((order % 21).cast("double") / 2).alias("vehicle_age"),
        F.when(order % 10 == 0, "n/a")
        .otherwise((800 + order % 2400).cast("string"))
        .alias("vehicle_engine_size"),
        F.when(order % 3 == 0, "n/a")
        .otherwise((150 + order % 60).cast("string"))
        .alias("vehicle_width_note"),
        (5000 + (order * 31) % 30000).cast("double").alias("vehicle_planned_annual_mileage"),
        (1000 + cust % 300).cast("string").alias("postal_code"),
        F.col("n_name").alias("municipality"),
        F.col("r_name").alias("province"),
        (F.lit(50.75) + ((cust * 7919) % 2750).cast("double") / 1000).alias("postal_code_latitude"),
        F.when(cust % 29 != 0, F.lit(3.3) + ((cust * 104729) % 3900).cast("double") / 1000).alias(
            "postal_code_longitude"
        ),
        F.when(
            F.col("n_nationkey") % 8 != 0, (20 + (F.col("n_nationkey") * 13) % 60).cast("double")
        ).alias("municipality_crimes_per_1000"),
        ((cust * 17) % 6000).cast("double").alias("postal_code_address_density"),
        *deductibles,
        *PRICE_COLS,
    )


def block(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col("block") == name)


def unpriced(df: DataFrame) -> DataFrame:
    """A later block as it arrives: without the price columns."""
    return df.drop(*PRICE_COLS)
