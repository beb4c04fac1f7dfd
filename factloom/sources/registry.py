"""Sources with their licences, and the layers that they feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Id, key, SPDX, attribution, share-alike, non-commercial. Ids are stored in facts and never change.
SOURCES = (
    (0, "usgs", "CC-PDDC", "U.S. Geological Survey", False, False),
    (1, "digitraffic", "CC-BY-4.0", "Fintraffic / digitraffic.fi", False, False),
    (2, "airplanes_live", "NOASSERTION", "airplanes.live", False, True),
    (3, "emsc", "CC-BY-4.0", "European-Mediterranean Seismological Centre", False, False),
    (4, "eonet", "CC-PDDC", "NASA EONET", False, False),
    (5, "gdacs", "CC-BY-4.0", "Global Disaster Alert and Coordination System", False, False),
    (6, "swpc", "CC-PDDC", "NOAA Space Weather Prediction Center", False, False),
    (7, "ports", "CC0-1.0 AND ODbL-1.0", "Curated selection; coordinates (c) OpenStreetMap contributors (ODbL)", True, False),
    (8, "chokepoints", "CC0-1.0 AND ODbL-1.0", "Curated selection; coordinates (c) OpenStreetMap contributors (ODbL)", True, False),
    (9, "nws", "CC-PDDC", "NOAA National Weather Service", False, False),
    (10, "celestrak", "NOASSERTION", "Orbital data from CelesTrak (T.S. Kelso)", False, False),
    (11, "recon", "NOASSERTION", "Google Public DNS; rdap.org; RIPE NCC; Shodan InternetDB; MITRE CVE", False, True),
)
SOURCE_ID = {key: number for number, key, *_ in SOURCES}
PUBLIC_DOMAIN = "CC-PDDC"

# Query names, position attribute, scalar attribute, other attributes, position is precise, identifying attribute.
LAYERS = (
    (("earthquakes", "quakes"), "position", "magnitude", ("depth", "label", "region"), False, None),
    (("vessels", "ships"), "vessel_position", "speed", (), True, None),
    (("ports", "terminals"), "port_position", "port_class", ("port_label",), False, None),
    (("chokepoints", "straits"), "chokepoint_position", "chokepoint_label", (), False, None),
    (("alerts", "disasters"), "alert_position", "alert_level", ("alert_label",), False, None),
    (("events", "wildfires"), "event_position", "event_intensity", ("event_label",), False, None),
    (("weather", "warnings"), "weather_position", "weather_severity", ("weather_label",), False, None),
    (("aircraft", "flights"), "aircraft_position", "altitude", ("aircraft_label",), True, "aircraft_label"),
    (("civil",), "civil_position", "civil_altitude", ("civil_label",), True, "civil_label"),
    (("satellites", "orbits"), "satellite_position", "satellite_altitude", ("satellite_label",), False, None),
    (("lookups", "recon"), "recon_position", "recon_label", (), False, None),
    (("aurora",), "aurora_position", "aurora_probability", (), False, None),
)

SCHEMA = "id int, key string, spdx string, attribution string, share_alike boolean, non_commercial boolean"


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SOURCES), SCHEMA)


def obligations(used: DataFrame, registry: DataFrame) -> DataFrame:
    """One row: who must be credited, whose terms carry over, what is non-commercial, for ``used(source)``.

    The registry is a dozen rows; the facts are only asked for their distinct sources.
    """
    ids = used.select(F.col("source").alias("id")).distinct()
    mine = registry.join(ids, "id", "left_semi")
    listed = lambda column, test: F.array_join(F.sort_array(F.collect_set(F.when(test, F.col(column)))), "; ")
    return mine.agg(
        listed("attribution", F.col("spdx") != PUBLIC_DOMAIN).alias("attribution"),
        listed("key", F.col("share_alike")).alias("share_alike"),
        listed("key", F.col("non_commercial")).alias("non_commercial"),
    )


def configure(session) -> None:
    """Register all layers with a session: names, sensitivities, identifying attributes."""
    from factloom.plans.policy import Sensitivity

    for names, geo, scalar, others, precise, identifying in LAYERS:
        session.register_source(names, geo, scalar)
        session.policy.declare(geo, Sensitivity.PRECISE if precise else Sensitivity.PUBLIC)
        for attr in (scalar, *others):
            session.policy.declare(attr, Sensitivity.PUBLIC, attr == identifying)
