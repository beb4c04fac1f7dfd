"""Recorded look-up answers (DNS, RDAP, routing, exposure, vulnerabilities) to records.

Each takes ``(subject, payload, asked_unix)`` rows and gives ``(probe, subject, fields,
position, from_unix, to_unix)``; fields are ``label: value`` pairs, joined to one text when
they become facts. Identity fields of registrants are dropped before anything is stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.sources.feeds import unpivot

DEFAULT_TTL, HOUR, DAY = 900, 3600, 86_400
CVE_ID = r"^CVE-\d{4}-\d{4,}$"
WARN_SCORE = 7.0
MAX_SUMMARY = 400


def _field(label: str, value: Column, warn: Column | None = None) -> Column:
    made = F.struct(F.lit(label).alias("label"), value.alias("value"), F.coalesce(warn, F.lit(False)).alias("warn") if warn is not None else F.lit(False).alias("warn"))
    return F.when(F.length(value) > 0, made)


def _result(rows: DataFrame, probe: str, fields: Column, to: Column, lat: Column | None = None, lon: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("double")
    return rows.select(
        F.lit(probe).alias("probe"), "subject", F.filter(fields, lambda x: x.isNotNull()).alias("fields"), (none if lat is None else lat).alias("lat"), (none if lon is None else lon).alias("lon"),
        F.col("asked_unix").alias("from_unix"), to.cast("long").alias("to_unix"),
    )


def dns(answers: DataFrame) -> DataFrame:
    """``payload`` holds ``{type: answer document}`` of the record types asked for; valid for the least time to live."""
    one = "struct<Answer:array<struct<data:string,TTL:long>>>"
    kinds = ("A", "AAAA", "MX", "NS", "TXT")
    rows = answers.withColumn("p", F.from_json("payload", ", ".join(f"{k} {one}" for k in kinds)))
    none = F.array().cast("array<struct<data:string,TTL:bigint>>")

    def of(kind: str) -> Column:
        return F.transform(F.coalesce(F.col(f"p.{kind}.Answer"), none), lambda a: F.struct(F.lit(kind).alias("k"), a["data"].alias("data"), a["TTL"].alias("ttl")))

    every = F.concat(*[of(k) for k in kinds])
    rows = rows.withColumn("all", F.filter(every, lambda a: F.length(a["data"]) > 0))
    rows = rows.withColumn("ttl", F.coalesce(F.array_min(F.filter(F.transform("all", lambda a: a["ttl"]), lambda t: t > 0)), F.lit(DEFAULT_TTL)))
    shown = F.transform("all", lambda a: F.struct(a["k"].alias("label"), a["data"].alias("value"), F.lit(False).alias("warn")))
    nothing = F.array(_field("result", F.lit("no records")))
    fields = F.concat(F.array(_field("ttl", F.concat(F.col("ttl").cast("string"), F.lit("s")))), F.when(F.size("all") > 0, shown).otherwise(nothing))
    return _result(rows, "dns", fields, F.col("asked_unix") + F.col("ttl"))


def rdap(answers: DataFrame) -> DataFrame:
    """Abuse contacts are shown; names, mail, phones and addresses of others are counted and dropped."""
    schema = "handle string, status array<string>, entities array<struct<roles:array<string>,contact:array<struct<key:string,value:string>>>>"
    rows = answers.withColumn("p", F.from_json("payload", schema))
    flat = F.flatten(F.transform(F.coalesce("p.entities", F.from_json(F.lit("[]"), "array<struct<roles:array<string>,contact:array<struct<key:string,value:string>>>>")), lambda e: F.transform(e["contact"], lambda c: F.struct(F.array_contains(e["roles"], "abuse").alias("abuse"), c["key"].alias("key"), c["value"].alias("value")))))
    rows = rows.withColumn("cards", F.filter(flat, lambda c: F.length(c["value"]) > 0))
    shown = F.filter("cards", lambda c: c["abuse"] & c["key"].isin("email", "tel"))
    dropped = F.size(F.filter("cards", lambda c: ~(c["abuse"] & c["key"].isin("email", "tel")) & c["key"].isin("fn", "email", "tel", "adr")))
    fields = F.concat(
        F.array(_field("handle", F.col("p.handle")), _field("status", F.array_join("p.status", ", "))),
        F.transform(shown, lambda c: F.struct(F.lit("abuse contact").alias("label"), c["value"].alias("value"), F.lit(False).alias("warn"))),
        F.array(_field("discarded", F.when(dropped > 0, F.concat(dropped.cast("string"), F.lit(" registrant identity field(s), dropped before the store"))))),
    )
    return _result(rows, "rdap", fields, F.col("asked_unix") + HOUR)


def asn(answers: DataFrame, countries: DataFrame) -> DataFrame:
    """Number, holder, block and registered country of an autonomous system.

    Placed at the centroid of the first two-letter country of the record (``countries(code,
    lat, lon)``, a table of the caller's), wherever that country's letters are known.
    """
    schema = "holder string, resource string, block struct<name:string>, attributes array<struct<key:string,value:string>>"
    bare = F.regexp_replace(F.trim("subject"), "(?i)^as", "")
    rows = answers.withColumn("p", F.from_json("payload", schema)).withColumn("bare", bare).withColumn("subject", F.concat(F.lit("AS"), "bare"))
    code = F.get(F.filter("p.attributes", lambda a: (F.lower(a["key"]) == "country") & F.trim(a["value"]).rlike("^[A-Za-z]{2}$")), F.lit(0))["value"]
    rows = rows.withColumn("code", F.upper(F.trim(code))).join(F.broadcast(countries), "code", "left")
    number = F.coalesce(F.when(F.length("p.resource") > 0, F.col("p.resource")), F.col("bare"))
    holder = F.coalesce(F.when(F.length("p.holder") > 0, F.col("p.holder")), F.lit("unknown"))
    # Labels of the fields, and what stands for an unknown country.
    told = (("as", F.concat(F.lit("AS"), number)), ("holder", holder), ("block", F.col("p.block.name")), ("registered in", F.coalesce("code", F.lit("not stated by the registry"))))
    fields = F.array(*[_field(label, value) for label, value in told])
    return _result(rows, "asn", fields, F.col("asked_unix") + HOUR, F.col("lat"), F.col("lon"))


def exposure(answers: DataFrame) -> DataFrame:
    """A null payload is a host that the index doesn't have; that answer is kept for a shorter time."""
    rows = answers.withColumn("p", F.from_json("payload", "ports array<int>, hostnames array<string>, tags array<string>, vulns array<string>"))
    ports = F.array_join(F.transform("p.ports", lambda x: x.cast("string")), ", ")
    known = F.array(
        _field("open ports", F.when(F.length(ports) > 0, ports).otherwise(F.lit("none indexed"))),
        _field("hostnames", F.array_join("p.hostnames", ", ")),
        _field("tags", F.array_join("p.tags", ", ")),
        _field("known cves", F.array_join("p.vulns", ", "), F.lit(True)),
    )
    missing = F.array(_field("result", F.lit("no record: this host is not in the index")))
    fields = F.when(F.col("payload").isNull(), missing).otherwise(known)
    return _result(rows, "exposure", fields, F.col("asked_unix") + F.when(F.col("payload").isNull(), DEFAULT_TTL).otherwise(HOUR))


def cve(answers: DataFrame) -> DataFrame:
    """Answers to identifiers of the right form; others are dropped."""
    schema = (
        "cveMetadata struct<datePublished:string,state:string>, containers struct<cna:struct<descriptions:array<struct<value:string>>,"
        "metrics:array<struct<cvssV3_1:struct<baseScore:double,baseSeverity:string>>>>>"
    )
    rows = answers.withColumn("subject", F.upper(F.trim("subject"))).where(F.col("subject").rlike(CVE_ID)).withColumn("p", F.from_json("payload", schema))
    metric = F.get(F.filter("p.containers.cna.metrics", lambda m: m["cvssV3_1"].isNotNull()), F.lit(0))["cvssV3_1"]
    rows = rows.withColumn("m", metric)
    fields = F.array(
        _field("cve", F.col("subject")),
        _field("state", F.col("p.cveMetadata.state")),
        _field("cvss v3.1", F.when(F.col("m.baseScore").isNotNull(), F.trim(F.concat_ws(" ", F.col("m.baseScore").cast("string"), "m.baseSeverity"))), F.col("m.baseScore") >= WARN_SCORE),
        _field("published", F.substring("p.cveMetadata.datePublished", 1, 10)),
        _field("summary", F.substring(F.get("p.containers.cna.descriptions.value", F.lit(0)), 1, MAX_SUMMARY)),
    )
    return _result(rows, "cve", fields, F.col("asked_unix") + DAY)


def records(results: DataFrame) -> DataFrame:
    """A label always; a position only where the answer has a place."""
    text = F.array_join(F.transform("fields", lambda f: F.concat_ws(": ", f["label"], f["value"])), "; ")
    rows = results.withColumns({"key": F.concat_ws(":", F.lit("recon"), "probe", "subject"), "system_unix": F.col("from_unix"), "named": F.concat_ws(" ", "probe", "subject", text)})
    return unpivot(rows, "recon", "recon_position", {}, {"recon_label": "named"})
