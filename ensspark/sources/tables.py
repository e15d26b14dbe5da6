"""Tracker tables on storage: typed reads, additive schema evolution, integrity report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ensspark import schemas


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project onto a schema; columns an older table lacks become null."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def read_vessels(spark: SparkSession, path: str) -> DataFrame:
    return conform(spark.read.parquet(path), schemas.VESSELS)


def read_voyages(spark: SparkSession, path: str) -> DataFrame:
    return conform(spark.read.parquet(path), schemas.VOYAGES)


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries; an undeclared default fills missing flags, tables without file lists are accepted."""
    rows = conform(spark.read.option("mergeSchema", True).parquet(path), schemas.ENTRIES)
    return rows.withColumn("is_declared", F.coalesce("is_declared", F.lit(False)))


def empty_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three empty tracker tables."""
    return tuple(spark.createDataFrame([], s) for s in (schemas.VESSELS, schemas.VOYAGES, schemas.ENTRIES))


def violations(vessels: DataFrame, voyages: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows that break a declared constraint: ``(table_name, id, rule)``."""

    def required(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
        missing = [F.when(F.col(c).isNull(), F.lit(f"{c} is null")) for c in columns]
        return df.select("id", F.explode(F.array_compact(F.array(*missing))).alias("rule")).select(
            F.lit(table).alias("table_name"), "id", "rule"
        )

    def orphans(df: DataFrame, table: str, key: str, parent: DataFrame) -> DataFrame:
        ids = parent.select(F.col("id").alias(key))
        return df.filter(F.col(key).isNotNull()).join(ids, key, "left_anti").select(
            F.lit(table).alias("table_name"), "id", F.lit(f"{key} has no parent").alias("rule")
        )

    repeated = (
        vessels.filter(F.col("name").isNotNull()).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).filter("n > 1")
    ).select(F.lit("vessels").alias("table_name"), "id", F.lit("name is not unique").alias("rule"))
    return (
        required(vessels, "vessels", ["name"])
        .unionByName(repeated)
        .unionByName(required(voyages, "voyages", ["vessel_id", "voyage_number"]))
        .unionByName(orphans(voyages, "voyages", "vessel_id", vessels))
        .unionByName(required(entries, "entries", ["voyage_id", "port", "arrival_date"]))
        .unionByName(orphans(entries, "entries", "voyage_id", voyages))
    )
