"""Port mapping kept as JSON: one settings object, or one object per port."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OBJECT = "port_mappings map<string,string>"
MAPPING = "port string, ref_num string"


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """``(port, ref_num)`` rows of either form; a missing or broken file gives an empty mapping.

    Only a missing path counts as missing: other failures of the storage are raised.
    """
    try:
        whole = spark.read.schema(OBJECT).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
        lines = spark.read.schema(MAPPING).option("mode", "PERMISSIVE").json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MAPPING)
    rows = lines.filter("port IS NOT NULL AND ref_num IS NOT NULL")
    return whole.select(F.explode("port_mappings").alias("port", "ref_num")).unionByName(rows)


def write_mapping(mapping: DataFrame, path: str) -> None:
    """Write the mapping as one JSON object per port, whatever its size."""
    mapping.select("port", "ref_num").write.mode("overwrite").json(path)
