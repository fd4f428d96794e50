"""The star-schema tables seen as a portfolio: market segments are studies, nations sites, customers subjects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """studyid, invid, subjid."""
    customer, nation = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    sited = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
    return sited.select(F.col("c_mktsegment").alias("studyid"), F.col("n_name").alias("invid"), F.col("c_custkey").alias("subjid"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """studyid, subjid, order_date, with the order's key, status, priority and price."""
    order, customer = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    own = order.join(customer, order.o_custkey == customer.c_custkey)
    return own.select(F.col("c_mktsegment").alias("studyid"), F.col("o_custkey").alias("subjid"), F.to_date("o_orderdate").alias("order_date"), "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")


def exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """studyid, subjid, first_date, last_date of each subject's orders."""
    return orders(spark, sf_dir).groupBy("studyid", "subjid").agg(F.min("order_date").alias("first_date"), F.max("order_date").alias("last_date"))


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """studyid, subjid, order_date, ship_date of each line; the range may be reversed."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", F.to_date("l_shipdate").alias("ship_date"))
    own = orders(spark, sf_dir).select("o_orderkey", "studyid", "subjid", "order_date")
    return own.join(line, own.o_orderkey == line.l_orderkey).select("studyid", "subjid", "order_date", "ship_date")


#: Target studies and their references.
STUDY_REF = [("BUILDING", "AUTOMOBILE"), ("BUILDING", "MACHINERY"), ("FURNITURE", "HOUSEHOLD"), ("FURNITURE", "MACHINERY"), ("FURNITURE", "AUTOMOBILE")]


def study_ref(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(rows or STUDY_REF, "study string, studyref string" + ", MinGroups int" * (len((rows or STUDY_REF)[0]) > 2))
