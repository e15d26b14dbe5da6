"""Tracker tables and declarations derived from the driver's tables, in Spark and in SQL.

The SQL twins below each view feed the oracles; both sides are written independently of the
operators under test.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ensspark.functions.values import literal_list
from ensspark.schemas import CHECKLIST_CODES, IMO_FLAGS, PORT_OFFICES

AS_OF = dt.date(1998, 7, 1)
UNKNOWN_IMO = "9999999"
IMOS = [*IMO_FLAGS, UNKNOWN_IMO]
PORTS = list(PORT_OFFICES)
FILE_CODES = CHECKLIST_CODES["GBLIV"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], index: Column) -> Column:
    """Element of a literal list by a 0-based index."""
    return F.element_at(literal_list(values), (index + 1).cast("int"))


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def vessels(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("id"), F.col("c_name").alias("name"), pick(IMOS, key % len(IMOS)).alias("imo_number")
    )


def voyages(spark: SparkSession, sf_dir: str) -> DataFrame:
    priority = F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("vessel_id"),
        F.concat(F.lit("V"), (F.col("o_orderkey") % 500).cast("string")).alias("voyage_number"),
        F.when(priority == "1-URGENT", "West Coast UK")
        .when(priority == "2-HIGH", "West Med")
        .when(priority == "3-MEDIUM", "Adriatic")
        .when(priority == "5-LOW", "Black Sea")
        .alias("service_name"),
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_suppkey").alias("supp"),
        F.min("l_partkey").alias("part"),
        F.min("l_shipdate").alias("ship"),
        F.min("l_linestatus").alias("status"),
    )
    part = F.col("part")
    return lines.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_orderkey").alias("voyage_id"),
        pick(PORTS, F.col("supp") % len(PORTS)).alias("port"),
        F.col("ship").cast("date").alias("arrival_date"),
        (F.col("status") == "F").alias("is_declared"),
        F.when(part % 3 == 1, "")
        .when(part % 3 == 2, F.concat(pick(FILE_CODES, part % 8), F.lit(", "), pick(FILE_CODES, (part + 3) % 8)))
        .alias("uploaded_files"),
    )


def tracker(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return vessels(spark, sf_dir), voyages(spark, sf_dir), entries(spark, sf_dir)


AS_OF_SQL = f"DATE '{AS_OF}'"

TRACKER_SQL = f"""
vessels AS (
  SELECT c_custkey AS id, c_name AS name, {sql_list(IMOS)}[c_custkey % {len(IMOS)} + 1] AS imo_number
  FROM customer),
voyages AS (
  SELECT o_orderkey AS id, o_custkey AS vessel_id, 'V' || (o_orderkey % 500) AS voyage_number,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'West Coast UK' WHEN '2-HIGH' THEN 'West Med'
      WHEN '3-MEDIUM' THEN 'Adriatic' WHEN '5-LOW' THEN 'Black Sea' END AS service_name
  FROM orders),
entries AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS voyage_id,
    {sql_list(PORTS)}[min(l_suppkey) % {len(PORTS)} + 1] AS port,
    CAST(min(l_shipdate) AS DATE) AS arrival_date,
    min(l_linestatus) = 'F' AS is_declared,
    CASE min(l_partkey) % 3 WHEN 1 THEN '' WHEN 2 THEN
      {sql_list(FILE_CODES)}[min(l_partkey) % 8 + 1] || ', ' || {sql_list(FILE_CODES)}[(min(l_partkey) + 3) % 8 + 1]
    END AS uploaded_files
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
details AS (
  SELECT v.id AS voyage_id, s.name AS vessel_name, v.voyage_number, v.service_name, e.id AS entry_id,
    e.port, e.arrival_date, e.is_declared, e.uploaded_files
  FROM voyages v JOIN vessels s ON v.vessel_id = s.id JOIN entries e ON e.voyage_id = v.id)
"""
