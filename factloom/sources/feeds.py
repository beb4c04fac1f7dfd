"""Raw feed payloads to records.

A payload table has ``payload`` (the JSON text as received) and ``fetched_unix``. An adapter
gives one row per attribute: ``(source, key, attr, kind, v_f64, v_str, v_lat_e7, v_lon_e7,
valid_from, valid_to, system_unix)``, which is the ingest form once keys have entity ids.
Rows that a feed's rules refuse are dropped; ``rejected`` counts them where asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import columns as C
from factloom.operators.graph import chain_roots
from factloom.sources.registry import SOURCE_ID

# Levels of alerts and severities.
GDACS_LEVEL = {"Green": 0, "Orange": 1, "Red": 2}
NWS_SEVERITY = {"Unknown": 0, "Minor": 1, "Moderate": 2, "Severe": 3, "Extreme": 4}
MIN_AURORA = 10
SPEED_UNKNOWN, COURSE_UNKNOWN = 102.3, 360.0
FORECAST_SECONDS = 1800
MIN_ZOOM, MAX_NM, KM_PER_NM = 4, 250, 1.852
RECORD = "source int, key string, attr string, kind int, v_f64 double, v_str string, v_lat_e7 int, v_lon_e7 int, valid_from int, valid_to int, system_unix long"


def parsed(payloads: DataFrame, schema: str) -> DataFrame:
    return payloads.select(F.from_json("payload", schema).alias("p"), "fetched_unix")


def iso_unix(text: Column) -> Column:
    """Unix seconds of an ISO-8601 text with its zone; without one it is UTC."""
    bare = F.regexp_replace(F.trim(text), r"([T ]\d{2}:\d{2}(?::\d{2})?)(\.\d+)?$", "$1$2Z")
    return F.unix_seconds(F.try_to_timestamp(F.regexp_replace(bare, " ", "T")))


def ms_unix(value: Column) -> Column:
    return F.floor(value / 1000).cast("long")


def level(text: Column, levels: dict[str, int]) -> Column:
    pairs = [F.lit(x) for item in levels.items() for x in item]
    return F.coalesce(F.create_map(*pairs)[text], F.lit(0)).cast("double")


def usable(lat: Column, lon: Column) -> Column:
    fine = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    return F.coalesce(fine & (F.abs(lat) != float("inf")) & (F.abs(lon) != float("inf")), F.lit(False))


def label(separator: str, *parts: Column) -> Column:
    """The parts that are neither null nor empty, joined."""
    return F.array_join(F.filter(F.array(*[F.trim(p) for p in parts]), lambda x: F.length(x) > 0), separator)


def unpivot(rows: DataFrame, source: str, geo_attr: str, numbers: dict[str, str], texts: dict[str, str]) -> DataFrame:
    """Rows ``(key, lat, lon, from_unix, to_unix, system_unix, ...)`` to one record per attribute that has a value.

    A null ``to_unix`` is open; a null position gives no position.
    """
    place = F.struct(F.lit(geo_attr).alias("attr"), F.lit(C.GEO).alias("kind"), F.lit(None).cast("double").alias("n"), F.lit(None).cast("string").alias("s"))
    made = [F.when(usable(F.col("lat"), F.col("lon")), place)]
    for attr, column in numbers.items():
        made.append(F.when(F.col(column).isNotNull(), F.struct(F.lit(attr).alias("attr"), F.lit(C.F64).alias("kind"), F.col(column).cast("double").alias("n"), F.lit(None).cast("string").alias("s"))))
    for attr, column in texts.items():
        made.append(F.when(F.length(column) > 0, F.struct(F.lit(attr).alias("attr"), F.lit(C.SYM).alias("kind"), F.lit(None).cast("double").alias("n"), F.col(column).alias("s"))))
    wide = rows.select("*", F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("a"))
    is_geo = F.col("a.kind") == C.GEO
    return wide.select(
        F.lit(SOURCE_ID[source]).alias("source"), "key", F.col("a.attr").alias("attr"), F.col("a.kind").alias("kind"), F.col("a.n").alias("v_f64"), F.col("a.s").alias("v_str"),
        F.when(is_geo, C.lat_e7(F.col("lat"))).alias("v_lat_e7"), F.when(is_geo, C.lon_e7(F.col("lon"))).alias("v_lon_e7"),
        C.from_unix(F.col("from_unix")).alias("valid_from"), F.coalesce(C.from_unix(F.col("to_unix")), F.lit(C.OPEN_VALID)).alias("valid_to"), F.col("system_unix").cast("long").alias("system_unix"),
    )


def never(name: str) -> Column:
    return F.lit(None).cast("long").alias(name)


def usgs(payloads: DataFrame) -> DataFrame:
    schema = "features array<struct<id:string,properties:struct<mag:double,time:double,updated:double,place:string>,geometry:struct<coordinates:array<double>>>>"
    f = parsed(payloads, schema).select(F.explode("p.features").alias("f"))
    at = F.get("f.geometry.coordinates", F.lit(0)), F.get("f.geometry.coordinates", F.lit(1)), F.get("f.geometry.coordinates", F.lit(2))
    rows = f.select(
        F.col("f.id").alias("key"), at[1].alias("lat"), at[0].alias("lon"), ms_unix(F.col("f.properties.time")).alias("from_unix"), never("to_unix"),
        ms_unix(F.coalesce("f.properties.updated", "f.properties.time")).alias("system_unix"), F.col("f.properties.mag").alias("mag"),
        F.coalesce(at[2], F.lit(0.0)).alias("depth"), F.coalesce("f.properties.place", F.lit("unknown")).alias("place"),
    )
    fine = usable(F.col("lat"), F.col("lon")) & F.col("from_unix").isNotNull() & (F.length("key") > 0)
    return unpivot(rows.where(fine), "usgs", "position", {"magnitude": "mag", "depth": "depth"}, {"label": "place"})


def emsc(payloads: DataFrame) -> DataFrame:
    schema = "features array<struct<id:string,properties:struct<unid:string,lat:double,lon:double,depth:double,mag:double,time:string,lastupdate:string,flynn_region:string>>>"
    f = parsed(payloads, schema).select(F.explode("p.features").alias("f")).select("f.id", "f.properties.*")
    known = F.coalesce("unid", "id", F.concat_ws(",", "lat", "lon", "time"))
    rows = f.select(
        F.concat(F.lit("emsc:"), known).alias("key"), "lat", "lon", iso_unix(F.col("time")).alias("from_unix"), never("to_unix"),
        F.coalesce(iso_unix(F.col("lastupdate")), iso_unix(F.col("time"))).alias("system_unix"), "mag", F.coalesce("depth", F.lit(0.0)).alias("depth"), F.col("flynn_region").alias("region"),
    )
    return unpivot(rows.where(usable(F.col("lat"), F.col("lon")) & F.col("from_unix").isNotNull()), "emsc", "position", {"magnitude": "mag", "depth": "depth"}, {"region": "region"})


def digitraffic(payloads: DataFrame) -> DataFrame:
    schema = "features array<struct<mmsi:long,geometry:struct<coordinates:array<double>>,properties:struct<sog:double,cog:double,timestampExternal:double>>>"
    f = parsed(payloads, schema).select(F.explode("p.features").alias("f"))
    at = ms_unix(F.col("f.properties.timestampExternal"))
    rows = f.select(
        F.concat(F.lit("mmsi:"), F.col("f.mmsi").cast("string")).alias("key"), F.get("f.geometry.coordinates", F.lit(1)).alias("lat"), F.get("f.geometry.coordinates", F.lit(0)).alias("lon"),
        at.alias("from_unix"), never("to_unix"), at.alias("system_unix"), F.when(F.col("f.properties.sog") < SPEED_UNKNOWN, F.col("f.properties.sog")).alias("speed"),
    )
    fine = F.col("key").isNotNull() & F.col("from_unix").isNotNull() & usable(F.col("lat"), F.col("lon"))
    return unpivot(rows.where(fine), "digitraffic", "vessel_position", {"speed": "speed"}, {})


def gdacs(payloads: DataFrame) -> DataFrame:
    schema = "features array<struct<properties:struct<eventtype:string,eventid:string,episodeid:string,alertlevel:string,eventname:string,name:string,fromdate:string,datemodified:string>,geometry:struct<coordinates:array<double>>>>"
    f = parsed(payloads, schema).select(F.explode("p.features").alias("f")).select("f.properties.*", F.col("f.geometry.coordinates").alias("c"))
    storm, told = F.trim(F.coalesce("eventname", F.lit(""))), F.trim(F.coalesce("name", F.lit("")))
    named = F.when((storm != "") & (told != ""), F.concat(told, F.lit(" ("), storm, F.lit(")"))).when(told != "", told).otherwise(storm)
    part = lambda c, none: F.coalesce(F.col(c), F.lit(none))
    rows = f.select(
        F.concat(F.lit("gdacs:"), part("eventtype", "?"), F.lit(":"), part("eventid", ""), F.lit(":"), part("episodeid", "")).alias("key"), F.get("c", F.lit(1)).alias("lat"), F.get("c", F.lit(0)).alias("lon"),
        iso_unix(F.col("fromdate")).alias("from_unix"), never("to_unix"), F.coalesce(iso_unix(F.col("datemodified")), iso_unix(F.col("fromdate"))).alias("system_unix"),
        level(F.coalesce("alertlevel", F.lit("Green")), GDACS_LEVEL).alias("level"), named.alias("named"),
    )
    return unpivot(rows.where(usable(F.col("lat"), F.col("lon")) & F.col("from_unix").isNotNull()), "gdacs", "alert_position", {"alert_level": "level"}, {"alert_label": "named"})


def eonet(payloads: DataFrame) -> DataFrame:
    """Its system time is when it was fetched."""
    schema = "events array<struct<id:string,title:string,categories:array<struct<title:string>>,geometry:array<struct<type:string,coordinates:array<double>,date:string>>>>"
    e = parsed(payloads, schema).select(F.explode("p.events").alias("e"), "fetched_unix").withColumn("g", F.element_at("e.geometry", -1)).where("g.type = 'Point'")
    rows = e.select(
        F.concat(F.lit("eonet:"), "e.id").alias("key"), F.get("g.coordinates", F.lit(1)).alias("lat"), F.get("g.coordinates", F.lit(0)).alias("lon"), iso_unix(F.col("g.date")).alias("from_unix"), never("to_unix"),
        F.col("fetched_unix").alias("system_unix"), F.lit(1.0).alias("one"), label(" — ", F.get("e.categories.title", F.lit(0)), F.col("e.title")).alias("named"),
    )
    return unpivot(rows.where(F.col("key").isNotNull() & usable(F.col("lat"), F.col("lon")) & F.col("from_unix").isNotNull()), "eonet", "event_position", {"event_intensity": "one"}, {"event_label": "named"})


def airplanes(payloads: DataFrame, civil: bool = False) -> DataFrame:
    schema = "now double, ac array<struct<hex:string,lat:double,lon:double,alt_baro:string,seen_pos:double,flight:string,t:string>>"
    a = parsed(payloads, schema).select(F.coalesce(ms_unix(F.col("p.now")), F.col("fetched_unix")).alias("now"), F.explode("p.ac").alias("a")).select("now", "a.*")
    at = F.col("now") - F.floor(F.coalesce("seen_pos", F.lit(0.0)) + 0.5)
    height = F.when(F.col("alt_baro") == "ground", F.lit(0.0)).otherwise(F.coalesce(F.col("alt_baro").try_cast("double"), F.lit(0.0)))
    rows = a.select(
        F.concat(F.lit("icao:"), "hex").alias("key"), "lat", "lon", at.alias("from_unix"), never("to_unix"), at.alias("system_unix"), height.alias("height"),
        label(" · ", F.coalesce("flight", F.lit("")), F.coalesce("t", F.lit(""))).alias("named"),
    )
    prefix, scalar = ("civil", "civil_altitude") if civil else ("aircraft", "altitude")
    return unpivot(rows.where(F.col("key").isNotNull() & usable(F.col("lat"), F.col("lon"))), "airplanes_live", f"{prefix}_position", {scalar: "height"}, {f"{prefix}_label": "named"})


def viewport_radius_nm(radius_km: float, zoom: float) -> int | None:
    """Radius that a viewport-scoped feed is asked for; None where the view is too wide to ask."""
    return None if zoom < MIN_ZOOM else max(1, min(MAX_NM, int(radius_km / KM_PER_NM + 0.5)))


def swpc(payloads: DataFrame) -> DataFrame:
    schema = "`Observation Time` string, `Forecast Time` string, coordinates array<array<double>>"
    c = parsed(payloads, schema).select(F.col("p.Observation Time").alias("seen"), F.col("p.Forecast Time").alias("told"), F.explode("p.coordinates").alias("c"))
    lon, lat, chance = (F.get("c", F.lit(i)) for i in range(3))
    start = iso_unix(F.col("told"))
    rows = c.select(
        lat.alias("lat"), F.when(lon > 180, lon - 360).otherwise(lon).alias("lon"), start.alias("from_unix"), (start + FORECAST_SECONDS).alias("to_unix"), iso_unix(F.col("seen")).alias("system_unix"), chance.alias("chance"),
    ).where((F.col("chance") >= MIN_AURORA) & F.col("from_unix").isNotNull() & F.col("system_unix").isNotNull())
    short = lambda c: F.format_string("%s", F.when(F.col(c) == F.floor(c), F.floor(c).cast("string")).otherwise(F.col(c).cast("string")))
    rows = rows.where(usable(F.col("lat"), F.col("lon"))).withColumn("key", F.concat(F.lit("swpc:aurora:"), short("lat"), F.lit(":"), short("lon")))
    return unpivot(rows, "swpc", "aurora_position", {"aurora_probability": "chance"}, {})


NWS_SCHEMA = (
    "features array<struct<properties:struct<id:string,references:array<struct<identifier:string>>,sent:string,onset:string,effective:string,ends:string,expires:string,"
    "event:string,areaDesc:string,severity:string,geocode:struct<UGC:array<string>>>,geometry:struct<type:string,coordinates:array<array<array<double>>>>>>"
)


def nws_alerts(payloads: DataFrame) -> DataFrame:
    """Usable alerts with their supersession root and the mean of the polygon's vertices, if they have one."""
    f = parsed(payloads, NWS_SCHEMA).select(F.explode("p.features").alias("f")).select("f.properties.*", "f.geometry").where("id IS NOT NULL")
    links = f.select(F.col("id").alias("child"), F.get("references.identifier", F.lit(0)).alias("parent")).where("parent IS NOT NULL")
    roots = chain_roots(links).withColumnRenamed("child", "id")
    sent = iso_unix(F.col("sent"))
    rows = f.join(roots, "id", "left").withColumns(
        {
            "root": F.coalesce("root", "id"),
            "system_unix": sent,
            "from_unix": F.coalesce(iso_unix(F.col("onset")), iso_unix(F.col("effective")), sent),
            "to_unix": F.coalesce(iso_unix(F.col("ends")), iso_unix(F.col("expires"))),
        }
    )
    rows = rows.where("system_unix IS NOT NULL AND to_unix > from_unix")
    ring = F.get("geometry.coordinates", F.lit(0))
    mean = lambda k: F.aggregate(F.transform(ring, lambda p: F.get(p, F.lit(k))), F.lit(0.0), lambda s, x: s + x) / F.size(ring)
    has = (F.col("geometry.type") == "Polygon") & (F.size(ring) >= 3)
    rows = rows.withColumn("centre", F.when(has, F.struct(F.lit("poly").alias("part"), mean(1).alias("lat"), mean(0).alias("lon"))))
    named = F.when(F.length("areaDesc") > 0, F.concat(F.coalesce("event", F.lit("Alert")), F.lit(" — "), "areaDesc")).otherwise(F.coalesce("event", F.lit("Alert")))
    return rows.select("root", "system_unix", "from_unix", "to_unix", level(F.col("severity"), NWS_SEVERITY).alias("severity"), named.alias("named"), "centre", F.col("geocode.UGC").alias("zones"))


def nws(payloads: DataFrame, zones: DataFrame) -> DataFrame:
    """Alerts by polygon, else by the centroids of their zones (``zones(zone, lat, lon)``); others are not placed."""
    rows = nws_alerts(payloads)
    at_poly = rows.where("centre IS NOT NULL").select("*", "centre.part", "centre.lat", "centre.lon").drop("centre", "zones")
    by_zone = rows.where("centre IS NULL").select("*", F.explode("zones").alias("zone")).join(zones, "zone")
    by_zone = by_zone.select("*", F.col("zone").alias("part")).drop("centre", "zones", "zone")
    placed = at_poly.unionByName(by_zone).withColumn("key", F.concat(F.lit("nws:"), "root", F.lit(":"), "part"))
    return unpivot(placed, "nws", "weather_position", {"weather_severity": "severity"}, {"weather_label": "named"})


def nws_unplaced(payloads: DataFrame, zones: DataFrame) -> DataFrame:
    rows = nws_alerts(payloads).where("centre IS NULL").withColumn("n", F.monotonically_increasing_id())
    found = rows.select("n", F.explode("zones").alias("zone")).join(zones, "zone").select("n").distinct()
    return rows.join(found, "n", "left_anti").agg(F.count("*").alias("unplaced"))


def curated(payloads: DataFrame, chokepoints: bool = False) -> DataFrame:
    """Ports, or chokepoints, of the curated file; known since it was written."""
    schema = "authoredUnix long, ports array<struct<name:string,country:string,lat:double,lon:double,class:int>>, chokepoints array<struct<name:string,lat:double,lon:double>>"
    p = parsed(payloads, schema).select(F.col("p.authoredUnix").alias("from_unix"), F.explode("p.chokepoints" if chokepoints else "p.ports").alias("x")).select("from_unix", "x.*")
    fine = usable(F.col("lat"), F.col("lon")) & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
    rows = p.where(fine).withColumns({"to_unix": F.lit(None).cast("long"), "system_unix": F.col("from_unix")})
    if chokepoints:
        rows = rows.withColumn("key", F.concat(F.lit("chokepoint:"), "name"))
        return unpivot(rows, "chokepoints", "chokepoint_position", {}, {"chokepoint_label": "name"})
    rows = rows.withColumns({"key": F.concat(F.lit("port:"), "name"), "named": label(" — ", F.col("name"), F.coalesce("country", F.lit("")))})
    return unpivot(rows, "ports", "port_position", {"port_class": "class"}, {"port_label": "named"})


def ring_centroid(rings: DataFrame, ring: str = "ring") -> DataFrame:
    """``rings`` with ``area2, lon, lat``: area-weighted centroid of ``ring array<array<double>>``; of a ring without area the vertex mean."""
    r = F.col(ring)
    ahead = F.slice(r, F.lit(2), F.size(r))
    after = F.concat(ahead, F.slice(r, F.lit(1), F.lit(1)))
    edges = F.zip_with(r, after, lambda a, b: F.struct(a[0].alias("x0"), a[1].alias("y0"), b[0].alias("x1"), b[1].alias("y1"), (a[0] * b[1] - b[0] * a[1]).alias("cross")))
    total = lambda f: F.aggregate("edges", F.lit(0.0), lambda s, e: s + f(e))
    out = rings.withColumn("edges", edges).withColumn("area2", total(lambda e: e["cross"]))
    flat = F.abs("area2") < 1e-12
    mean = lambda k: F.aggregate(F.transform(r, lambda p: p[k]), F.lit(0.0), lambda s, x: s + x) / F.size(r)
    lon = F.when(flat, mean(0)).otherwise(total(lambda e: (e["x0"] + e["x1"]) * e["cross"]) / (F.col("area2") * 3))
    lat = F.when(flat, mean(1)).otherwise(total(lambda e: (e["y0"] + e["y1"]) * e["cross"]) / (F.col("area2") * 3))
    return out.withColumns({"lon": lon, "lat": lat}).drop("edges")


def zone_centroids(rings: DataFrame) -> DataFrame:
    """``(zone, lat, lon)`` from the largest ring of each zone of ``rings(zone, ring)``."""
    found = ring_centroid(rings).select("zone", F.struct(F.abs("area2").alias("size"), "lat", "lon").alias("c"))
    return found.groupBy("zone").agg(F.max("c").alias("c")).select("zone", "c.lat", "c.lon")


def entity_ids(records: DataFrame, registry: DataFrame) -> DataFrame:
    """Records with the entity ids of ``registry(key, entity_id)``."""
    return records.join(registry, "key").withColumnRenamed("entity_id", "entity").drop("key")
