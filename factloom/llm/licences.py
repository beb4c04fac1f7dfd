"""Licence scan: TF-IDF cosine to templates, then inheritance along the path.

Texts that speak of licences give units: each line that does, each paragraph of which such lines
are a part, and the whole text where they are a good part of it or the file is named as a
licence. Each distinct unit is compared once with the templates (notices, headers, titles and
full texts of common licences) by the cosine of sparse TF-IDF vectors of words and pairs of
words; inverse frequencies are those of the templates, other terms count as rare. Words for
"version" are left out and ".0" is dropped, so that ways to write a version agree. A unit has
the licence of its nearest template if the score is high enough and no other licence comes
within ``margin``; names of families without a version are templates too, of no licence. An
SPDX identifier that is known counts as score 1.

A text's own licence is that of its best unit. A licence file is one named so, or whose whole
text is near a template; it licenses its folder and all below, and a file without a licence
of its own inherits from the nearest such folder above it.

Only DataFrame functions are used. Units are made distinct before they are compared, and
folders before they are resolved, so a unit or folder that many files share costs one row;
tables of units' owners and of folders are broadcast only if they are small.

Edge cases: null or empty texts have no units but may inherit; a null path counts as a file
in the top folder; of equal scores the first licence by name wins, of several licence files
in a folder the best score, then the first path; very long texts cost time in proportion, and
are compared whole only under the rule above; repeated rows stay; empty tables give an empty
result; other columns pass through, columns named as the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.licence_texts import TEMPLATES
from factloom.runtime import cut_lineage

SIGNS = ("licen", "copyright", "spdx", "redistribut", "permission", "public domain", "warrant", "gpl", "cc0", "creative commons", "unencumbered")
TOKEN, VERSION_WORDS = r"[a-z0-9]+(?:\.[0-9]+)*", ("version", "v")
BLANK_LINE = r"\n[ \t*#/;%-]*\n"
SPDX, SPDX_SUFFIX = r"spdx-license-identifier:[ \t]*([a-z0-9.+-]+)", r"(-only|-or-later|\+)$"
LICENCE_FILE = r"(^|/)(licen[cs]e|copying|notice)[^/]*$"
SCORE, MARGIN = 0.5, 0.015
#: Parts of a paragraph and of a text that lines with signs must be for it to be compared as a whole.
BLOCK_SHARE, FILE_SHARE = 0.15, 0.25
#: Tables are broadcast up to so many rows, and joined by shuffle beyond (Spark splits skewed keys).
BROADCAST_ROWS = 500_000
ADDED = ("own_licence", "own_score", "licence", "basis", "inherited_from")
Templates = dict[str, tuple[str, ...]]


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _terms(text: Column) -> Column:
    """Words without words for a version and without closing ".0", and pairs of such words."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), lambda w: ~w.isin(*VERSION_WORDS))
    return F.transform(words, lambda w: F.regexp_replace(F.regexp_replace(w, r"(\.0)+$", ""), r"^v([0-9][0-9.]*)$", "$1"))


def _counted(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, term, tf)``: the terms of each row's text."""
    split = rows.select(key, _terms(F.col(text)).alias("ws"))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("ws") - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get("ws", i - 1), F.get("ws", i)))
    pairs = F.when(F.size("ws") > 1, pairs).otherwise(F.array().cast("array<string>"))
    return split.select(key, F.explode_outer(F.concat("ws", pairs)).alias("term")).where("term IS NOT NULL").groupBy(key, "term").agg(F.count("*").alias("tf"))


def _speaks(text: Column) -> Column:
    low = F.lower(text)
    test = low.contains(SIGNS[0])
    for sign in SIGNS[1:]:
        test = test | low.contains(sign)
    return test


def template_weights(spark: SparkSession, templates: Templates) -> DataFrame:
    """``(template, name, term, weight, idf, norm)`` of the templates; as small as the list of them."""
    flat = [(i, name, text) for i, (name, text) in enumerate((n, t) for n, ts in sorted(templates.items()) for t in ts)]
    rows = spark.createDataFrame(flat, "template int, name string, text string")
    counts = _counted(rows, "template", "text")
    idf = counts.groupBy("term").agg((F.log(F.lit(1.0 + len(flat)) / (F.count("*") + 1)) + 1).alias("idf"))
    weighed = counts.join(F.broadcast(idf), "term").withColumn("weight", F.col("tf") * F.col("idf"))
    norms = weighed.groupBy("template").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return weighed.join(F.broadcast(norms), "template").join(F.broadcast(rows.select("template", "name")), "template").select("template", "name", "term", "weight", "idf", "norm")


def unit_licences(units: DataFrame, templates: Templates | None = None, score: float = SCORE, margin: float = MARGIN) -> DataFrame:
    """``(unit, name, score)`` of the distinct ``units(unit, text)`` that come near one licence; ``unit`` is a short key, as rows per term carry it."""
    templates = templates or TEMPLATES
    weights = cut_lineage(template_weights(units.sparkSession, templates))
    rare = F.log(F.lit(1.0 + sum(map(len, templates.values())))) + 1
    vectors = _counted(units, "unit", "text").join(F.broadcast(weights.select("term", "idf").distinct()), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", rare))
    norms = vectors.groupBy("unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("unit_norm"))
    dots = vectors.join(F.broadcast(weights.select("template", "name", "term", "weight", "norm")), "term")
    dots = dots.groupBy("unit", "template", "name", "norm").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    cosine = dots.join(norms, "unit").withColumn("score", F.round(F.col("dot") / (F.col("norm") * F.col("unit_norm")), 6))
    scored = cosine.groupBy("unit", "name").agg(F.max("score").alias("score"))

    ids = F.create_map(*[F.lit(x) for n in sorted(templates) if n for x in (n.lower(), n)])
    given = F.regexp_replace(F.regexp_extract(F.lower("text"), SPDX, 1), SPDX_SUFFIX, "")
    known = units.select("unit", F.try_element_at(ids, given).alias("name")).where("name IS NOT NULL").select("unit", "name", F.lit(1.0).alias("score"), F.lit(1).alias("given"))
    every = scored.select("unit", "name", "score", F.lit(0).alias("given")).unionByName(known)
    place = F.struct((-F.col("given")).alias("given"), (-F.col("score")).alias("back"), "name")
    ranked = every.groupBy("unit").agg(F.min(place).alias("best"), F.sort_array(F.collect_list(F.struct("score", "name")), asc=False).alias("all"))
    others = F.filter("all", lambda x: x["name"] != F.col("best.name"))
    second = F.coalesce(F.get(others, 0)["score"], F.lit(0.0))
    own = -F.col("best.back")
    fine = (F.col("best.given") == -1) | ((own >= score) & (F.round(own - second, 6) >= margin))
    return ranked.where(fine & (F.col("best.name") != "")).select("unit", F.col("best.name").alias("name"), own.alias("score"))


def _units(text: Column, path: Column) -> Column:
    """The lines, paragraphs and perhaps the whole of a text that are compared."""

    def signed(part: Column) -> Column:
        return F.filter(F.split(part, "\n"), _speaks)

    def length(lines: Column) -> Column:
        return F.aggregate(lines, F.lit(0), lambda n, line: n + F.length(line))

    blocks = F.filter(F.split(text, BLANK_LINE), lambda b: b.contains("\n") & _speaks(b) & (length(signed(b)) >= BLOCK_SHARE * F.length(b)))
    named = F.coalesce(F.lower(path).rlike(LICENCE_FILE), F.lit(False))
    whole = F.when(named | (length(signed(text)) >= FILE_SHARE * F.length(text)), F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(signed(text), blocks, whole))


def _parent(path: Column) -> Column:
    return F.regexp_replace(F.coalesce(path, F.lit("")), r"/?[^/]*$", "")


def scan(files: DataFrame, templates: Templates | None = None, score: float = SCORE, margin: float = MARGIN) -> DataFrame:
    """``files(path, text, ...)`` with own and inherited licences, without ``text``."""
    rest = [c for c in files.columns if c not in ("text", *ADDED)]
    rows = files.select(F.struct(*rest).alias("row"), "path", "text", F.xxhash64("path", "text").alias("mark"))
    heads = rows.where(_speaks(F.col("text"))).select("path", "mark", "text").dropDuplicates(["path", "mark"])
    heads = heads.select("path", "mark", "text", _units(F.col("text"), F.col("path")).alias("units"))
    heads = heads.select("path", "mark", F.xxhash64("text").alias("of"), F.explode_outer("units").alias("unit")).where("unit IS NOT NULL")
    heads = heads.select("path", "mark", F.col("unit").alias("text"), F.md5(F.col("unit").cast("binary")).alias("unit"), (F.col("of") == F.xxhash64("unit")).alias("whole"))
    heads = cut_lineage(heads)  # read from all texts once
    units = heads.groupBy("unit").agg(F.first("text").alias("text"))
    found = heads.drop("text").join(unit_licences(units, templates, score, margin), "unit")
    own = found.groupBy("path", "mark").agg(F.min(F.struct((-F.col("score")).alias("back"), "name")).alias("best"), F.max("whole").alias("whole"))
    own = cut_lineage(own.select("path", "mark", F.col("best.name").alias("own_licence"), (-F.col("best.back")).alias("own_score"), "whole"))

    is_file = F.coalesce(F.lower("path").rlike(LICENCE_FILE), F.lit(False)) | F.col("whole")
    giving = own.where(is_file).select(_parent(F.col("path")).alias("folder"), "path", "own_licence", "own_score")
    giving = giving.groupBy("folder").agg(F.min(F.struct((-F.col("own_score")).alias("back"), F.coalesce("path", F.lit("")).alias("path"), "own_licence")).alias("g"))
    giving = giving.select(F.col("folder").alias("above"), F.col("g.own_licence").alias("given"), F.col("g.path").alias("inherited_from"))

    folders = rows.select(_parent(F.col("path")).alias("folder")).distinct()
    parts = F.split("folder", "/")
    chain = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    chain = folders.select("folder", F.posexplode(chain).alias("depth", "above"))
    nearest = chain.join(_small(giving), "above").groupBy("folder").agg(F.max(F.struct("depth", "given", "inherited_from")).alias("near"))
    nearest = _small(cut_lineage(nearest.select("folder", F.col("near.given").alias("given"), F.col("near.inherited_from").alias("inherited_from"))))

    own = _small(own.select(F.col("path").alias("own_path"), F.col("mark").alias("own_mark"), "own_licence", "own_score"))
    out = rows.drop("text").join(own, rows["path"].eqNullSafe(F.col("own_path")) & (rows["mark"] == F.col("own_mark")), "left")
    out = out.withColumn("folder", _parent(F.col("path"))).join(nearest, "folder", "left")
    basis = F.when(F.col("own_licence").isNotNull(), "header").when(F.col("given").isNotNull(), "inherited").otherwise("none")
    return out.select(
        "row.*", "own_licence", "own_score", F.coalesce("own_licence", "given").alias("licence"), basis.alias("basis"),
        F.when(F.col("own_licence").isNull(), F.col("inherited_from")).alias("inherited_from"),
    )


def oracle_sql() -> str:
    quoted = lambda t: t.replace("'", "''")
    flat = [(n, t) for n, ts in sorted(TEMPLATES.items()) for t in ts]
    rows = ", ".join(f"({i}, '{n}', '{quoted(t)}')" for i, (n, t) in enumerate(flat))
    names = ", ".join(f"('{n.lower()}', '{n}')" for n in sorted(TEMPLATES) if n)
    speaks = lambda x: "(" + " OR ".join(f"contains(lower({x}), '{s}')" for s in SIGNS) + ")"
    signed = lambda x: f"list_filter(string_split({x}, chr(10)), lambda l: {speaks('l')})"
    length = lambda x: f"coalesce(list_sum(list_transform({x}, lambda l: length(l))), 0)"
    token = rf"list_filter(regexp_extract_all(lower({{0}}), '{TOKEN}'), lambda w: w NOT IN ('version', 'v'))"
    words = rf"list_transform({token}, lambda w: regexp_replace(regexp_replace(w, '(\.0)+$', ''), '^v([0-9][0-9.]*)$', '\1'))"
    terms = "list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))"
    n = len(flat)
    return rf"""
WITH files AS (
    SELECT doc_id, concat_ws('/', source, lang, CAST(doc_id AS VARCHAR)) AS path, text FROM documents),
templates AS (SELECT * FROM (VALUES {rows}) AS t(template, name, text)),
ids AS (SELECT * FROM (VALUES {names}) AS t(id, name)),
tw0 AS (SELECT template, {words.format('text')} AS ws FROM templates),
tf AS (SELECT template, term, count(*) AS tf FROM (SELECT template, unnest({terms}) AS term FROM tw0) GROUP BY ALL),
idf AS (SELECT term, ln({1.0 + n} / (count(*) + 1)) + 1 AS idf FROM tf GROUP BY term),
tw AS (SELECT tf.template, tf.term, tf * idf AS weight FROM tf JOIN idf USING (term)),
tn AS (SELECT template, sqrt(sum(weight * weight)) AS norm FROM tw GROUP BY template),
spoken AS (SELECT DISTINCT path, text FROM files WHERE {speaks('text')}),
units AS (
    SELECT path, text, unnest(list_distinct(list_concat(list_concat(
        {signed('text')},
        list_filter(regexp_split_to_array(text, '{BLANK_LINE}'), lambda b: contains(b, chr(10)) AND {speaks('b')} AND {length(signed('b'))} >= {BLOCK_SHARE} * length(b))),
        CASE WHEN regexp_matches(lower(path), '{LICENCE_FILE}') OR {length(signed('text'))} >= {FILE_SHARE} * length(text) THEN [text] ELSE [] END))) AS unit
    FROM spoken),
distinct_units AS (SELECT DISTINCT unit FROM units),
uw AS (SELECT unit, {words.format('unit')} AS ws FROM distinct_units),
uf AS (SELECT unit, term, count(*) AS tf FROM (SELECT unit, unnest({terms}) AS term FROM uw) GROUP BY ALL),
uv AS (SELECT unit, uf.term, tf * coalesce(idf, ln({1.0 + n}) + 1) AS w FROM uf LEFT JOIN idf ON uf.term = idf.term),
un AS (SELECT unit, sqrt(sum(w * w)) AS norm FROM uv GROUP BY unit),
cosine AS (
    SELECT uv.unit, t.name, round(sum(w * weight) / (any_value(tn.norm) * any_value(un.norm)), 6) AS score
    FROM uv JOIN tw ON uv.term = tw.term JOIN tn ON tn.template = tw.template JOIN un ON un.unit = uv.unit JOIN templates t ON t.template = tw.template
    GROUP BY uv.unit, tw.template, t.name),
given AS (
    SELECT unit, ids.name, 1.0::DOUBLE AS score, 1 AS given FROM distinct_units
    JOIN ids ON ids.id = regexp_replace(regexp_extract(lower(unit), '{SPDX}', 1), '{SPDX_SUFFIX}', '')),
scored AS (SELECT unit, name, max(score) AS score, 0 AS given FROM cosine GROUP BY unit, name UNION ALL SELECT * FROM given),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY unit ORDER BY given DESC, score DESC, name) = 1),
second AS (SELECT s.unit, max(s.score) AS score FROM scored s JOIN best b ON s.unit = b.unit AND s.name <> b.name GROUP BY s.unit),
named AS (
    SELECT best.unit, best.name, best.score FROM best LEFT JOIN second ON best.unit = second.unit
    WHERE best.name <> '' AND (given = 1 OR (best.score >= {SCORE} AND round(best.score - coalesce(second.score, 0), 6) >= {MARGIN}))),
found AS (SELECT path, name, score, units.unit = text AS whole FROM units JOIN named ON units.unit = named.unit),
own AS (SELECT path, bool_or(whole) AS whole, max(score) AS own_score, arg_min(name, (-score, name)) AS own_licence FROM found GROUP BY path),
giving AS (
    SELECT regexp_replace(path, '/?[^/]*$', '') AS above, own_licence AS given, path AS inherited_from FROM own
    WHERE regexp_matches(lower(path), '{LICENCE_FILE}') OR whole
    QUALIFY row_number() OVER (PARTITION BY regexp_replace(path, '/?[^/]*$', '') ORDER BY own_score DESC, path) = 1),
folders AS (SELECT DISTINCT regexp_replace(path, '/?[^/]*$', '') AS folder FROM files),
near AS (
    SELECT folder, given, inherited_from FROM folders JOIN giving ON above = '' OR folder = above OR starts_with(folder, above || '/')
    QUALIFY row_number() OVER (PARTITION BY folder ORDER BY length(above) DESC) = 1)
SELECT doc_id, f.path, own_licence, own_score, coalesce(own_licence, given) AS licence,
       CASE WHEN own_licence IS NOT NULL THEN 'header' WHEN given IS NOT NULL THEN 'inherited' ELSE 'none' END AS basis,
       CASE WHEN own_licence IS NULL THEN inherited_from END AS inherited_from
FROM files f LEFT JOIN own ON f.path = own.path LEFT JOIN near ON near.folder = regexp_replace(f.path, '/?[^/]*$', '')
"""
