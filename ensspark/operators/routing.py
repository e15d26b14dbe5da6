"""Route repair and GB filing rules.

All of it is row-local once the vessel's route is joined in: itineraries, offices and route slices
are short arrays inside the row, so nothing but the route lookup moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ensspark.functions.text import strip
from ensspark.functions.values import country, literal_map, position, same_text, slice_between
from ensspark.schemas import GB_PORT, GB_PORT_ALIAS, PORT_OFFICES

# Element paths and reasons that the audit carries.
ITINERARY_PATH = "Itinerary Section"
OFFICES_PATH = "CustOfficeOfSubsequentEntry Section"
ITINERARY_REASON = "Rebuilt Itinerary with 2-letter country codes based on vessel route."
OFFICES_REASON = "Rebuilt Subsequent Entries based on vessel route."


def with_route(df: DataFrame, routes: DataFrame, imo: Column) -> DataFrame:
    """Add ``route`` and ``ports`` of the vessel; null for a vessel on no route.

    ``routes(imo, route, ports)`` has one row per vessel. The optimizer broadcasts it while its
    known size allows that, else it is an ordinary equi-join.
    """
    keyed = df.withColumn("_imo", strip(imo))
    return keyed.join(routes.withColumnRenamed("imo", "_imo"), "_imo", "left").drop("_imo")


def office_to_port(offices: dict[str, str]) -> dict[str, str]:
    """Reverse of a port -> office mapping; the first port of an office counts."""
    reverse: dict[str, str] = {}
    for port, office in offices.items():
        reverse.setdefault(office, port)
    return reverse


def joined(values: Column) -> Column:
    """Trimmed values as one text."""
    return F.array_join(F.transform(F.coalesce(values, F.array().cast("array<string>")), strip), ", ")


def repair_routes(
    df: DataFrame,
    ports: Column,
    pol: Column,
    pou: Column,
    first_office: Column,
    itinerary: Column,
    offices: Column,
    known_offices: dict[str, str] | None = None,
) -> DataFrame:
    """Add ``new_itinerary``, ``new_offices`` and ``corrections``.

    The itinerary becomes the countries of the route from loading to unloading port; the subsequent
    offices become those of the ports after the first entry. Nothing changes where a port is not
    on the route, loading is not before unloading, or a tag is missing; offices also stay where the
    first office is unknown. A list is replaced only if it differs, case aside.
    """
    known = PORT_OFFICES if known_offices is None else known_offices
    first_port = F.try_element_at(literal_map(office_to_port(known)), strip(first_office))
    start, end = position(ports, strip(pol)), position(ports, strip(pou))
    entry = position(ports, first_port)
    valid = F.coalesce(
        (start > 0) & (end > start) & first_office.isNotNull(),
        F.lit(False),
    )
    found = (
        df.withColumn("_route_countries", F.when(valid, F.transform(slice_between(ports, start, end), country)))
        .withColumn(
            "_route_offices",
            F.when(
                valid & first_port.isNotNull(),
                F.coalesce(
                    F.when(
                        (entry > 0) & (end > entry),
                        F.filter(
                            F.transform(
                                slice_between(ports, entry + 1, end),
                                lambda port: F.try_element_at(literal_map(known), port),
                            ),
                            lambda office: office.isNotNull(),
                        ),
                    ),
                    F.array().cast("array<string>"),
                ),
            ),
        )
    )

    def differs(new: str, old: Column) -> Column:
        changed = ~same_text(joined(F.col(new)), joined(old))
        return F.col(new).isNotNull() & changed

    def audit(changed: Column, path: str, new: str, old: Column, reason: str) -> Column:
        row = F.struct(
            F.lit(path).alias("element_path"),
            joined(old).alias("original_value"),
            joined(F.col(new)).alias("corrected_value"),
            F.lit(reason).alias("reason"),
        )
        return F.when(changed, row)

    itinerary_off = differs("_route_countries", itinerary)
    offices_off = differs("_route_offices", offices)
    return (
        found.withColumn("new_itinerary", F.when(itinerary_off, F.col("_route_countries")).otherwise(itinerary))
        .withColumn("new_offices", F.when(offices_off, F.col("_route_offices")).otherwise(offices))
        .withColumn(
            "corrections",
            F.array_compact(
                F.array(
                    audit(itinerary_off, ITINERARY_PATH, "_route_countries", itinerary, ITINERARY_REASON),
                    audit(offices_off, OFFICES_PATH, "_route_offices", offices, OFFICES_REASON),
                )
            ),
        )
        .drop("_route_countries", "_route_offices")
    )


def correction_audit(df: DataFrame, document: str) -> DataFrame:
    """One row per correction of a document."""
    return df.select(document, F.explode("corrections").alias("c")).select(document, "c.*")


def gb_status(ports: Column, pou: Column) -> Column:
    """Whether a document unloads at or after the GB port of its vessel's route."""
    effective = F.when(F.lower(pou) == GB_PORT_ALIAS.lower(), GB_PORT).otherwise(pou)
    gb, at = position(ports, F.lit(GB_PORT)), position(ports, effective)
    return (
        F.when(ports.isNull(), "unknown_vessel")
        .when(F.coalesce(pou, F.lit("")) == "", "missing_pou")
        .when(gb == 0, "not_in_route")
        .when(at == 0, "unknown_pou")
        .when(at >= gb, "required")
        .otherwise("not_required")
    )


def office_lookup(df: DataFrame, offices: DataFrame, port: str, old: str | None = None, name: str = "ref_num") -> DataFrame:
    """Office of a port, ignoring case; a miss keeps the old reference, or gives empty text."""
    table = offices.select(F.upper("port").alias("_port"), F.col("ref_num").alias("_ref"))
    fallback = F.col(old) if old else F.lit("")
    return (
        df.withColumn("_port", F.upper(port))
        .join(table, "_port", "left")
        .withColumn(name, F.coalesce(F.nullif("_ref", F.lit("")), fallback))
        .drop("_port", "_ref")
    )
