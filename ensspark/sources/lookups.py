"""Lookup tables. The built-in ones are literal relations, so their size is known to the optimizer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ensspark.schemas import IMO_FLAGS, PORT_OFFICES, ROUTE_PORTS, ROUTE_VESSELS


def _values(spark: SparkSession, rows: list[tuple[str, ...]], names: str) -> DataFrame:
    text = ", ".join("(" + ", ".join(f"'{v}'" for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {text} AS t({names})")


def port_offices(spark: SparkSession) -> DataFrame:
    """Port -> customs office: ``(port, ref_num)``."""
    return _values(spark, list(PORT_OFFICES.items()), "port, ref_num")


def imo_flags(spark: SparkSession) -> DataFrame:
    """IMO -> flag state: ``(imo, flag)``."""
    return _values(spark, list(IMO_FLAGS.items()), "imo, flag")


def vessel_routes(spark: SparkSession) -> DataFrame:
    """IMO -> route and its ports in order: ``(imo, route, ports)``; the first route of a vessel wins."""
    seen: dict[str, str] = {}
    for route, imos in ROUTE_VESSELS.items():
        for imo in imos:
            seen.setdefault(imo, route)
    rows = [(imo, route, " ".join(ROUTE_PORTS[route])) for imo, route in seen.items()]
    return _values(spark, rows, "imo, route, listed").selectExpr("imo", "route", "split(listed, ' ') AS ports")
