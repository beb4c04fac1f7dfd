"""Benchmark decontamination with SimHash over windows of each item's size.

Words are runs of letters and digits in lower case, shingles five words in a row, hashed to
64 bits. For an item of n shingles the windows are stretches of n shingles of a document.
A window that is similar to an item can be moved on to the first shingle that they share
without losing any, so a window is only held against the items that have its first shingle,
and only where enough of the item's shingles follow for the similarity asked for. Both
steps lose no pair that the last step would accept.

Each window and each item gets a 64-bit SimHash of its weighted shingles. Fingerprints
within ``radius`` agree on one of ``radius + 1`` bit blocks; a window and the items it is
held against meet on block values, are held to the radius, and the rest is verified by the
exact weighted Jaccard similarity of their shingles.

Texts are cut into chunks of shingles before windows are taken from them, so that a long
text with many windows costs time and memory in proportion to its words.

Only DataFrame functions are used; counters of 64 bits are summed in 32 packed words.

Edge cases: null or wordless texts and items never match; an item of fewer than five words
only matches a document of the same words; a document shorter than an item is one window;
of equally similar windows of a document the first counts; items that are equal are all
reported; rows with equal id and text count once; null ids are kept; empty tables give an
empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.runtime import cut_lineage

SHINGLE = 5
SIMILARITY = 0.8
#: At similarity 0.8 fingerprints differ in 10 bits on average, with a deviation below 3.
RADIUS = 20
#: Item shingles are broadcast up to so many rows, and joined by shuffle beyond.
BROADCAST_ROWS = 1_000_000
#: Shingles of a text that are handled together.
CHUNK = 1024


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def shingles(tokens: Column, size: int = SHINGLE) -> Column:
    """Hashes of all word shingles; of the whole sequence if it is shorter, none if it is empty."""
    every = F.transform(F.sequence(F.lit(0), F.size(tokens) - size), lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(size)]))
    none = F.array().cast("array<bigint>")
    return F.when(F.size(tokens) >= size, every).when(F.size(tokens) > 0, F.array(F.xxhash64(tokens))).otherwise(none)


def _lanes(h: Column) -> list[Column]:
    """Sums of the hash's bits: lane k holds bit k in its low half and bit k + 32 in its high half."""
    return [F.sum(F.shiftrightunsigned(h, k).bitwiseAND(F.lit(0x0000000100000001))).alias(f"lane{k}") for k in range(32)]


def _fingerprint(count: Column) -> Column:
    bits = []
    for k in range(32):
        low = F.col(f"lane{k}").bitwiseAND(F.lit(0xFFFFFFFF))
        high = F.shiftrightunsigned(F.col(f"lane{k}"), 32)
        bits += [(2 * low > count, k), (2 * high > count, k + 32)]
    return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(test.cast("long"), k) for test, k in bits])


def _simhash(rows: DataFrame, *keys: str) -> DataFrame:
    """A fingerprint ``fp`` per key over the shingles ``h``, with their number ``n``."""
    summed = rows.groupBy(*keys).agg(F.count("*").alias("n"), *_lanes(F.col("h")))
    return summed.select(*keys, "n", _fingerprint(F.col("n")).alias("fp"))


def _blocks(radius: int) -> Column:
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    parts = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << b - a) - 1)) for a, b in zip(cuts, cuts[1:], strict=False)]
    return F.explode(F.array(*[F.struct(F.lit(i).alias("block"), p.alias("value")) for i, p in enumerate(parts)]))


def _small(df: DataFrame) -> DataFrame:
    """With a broadcast hint if the table is small; beyond that a sort-merge join, whose skewed keys Spark splits."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _same(left: str, right: str, *names: str) -> Column:
    same = F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id"))
    for name in names:
        same = same & (F.col(f"{left}.{name}") == F.col(f"{right}.{name}"))
    return same


def candidates(placed: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """``(doc_id, mark, size, start, item_id)``: windows of ``placed(doc_id, mark, n, at, h)`` that begin with a shingle of an item and may be similar to it."""
    hits = placed.join(_small(items.distinct()), "h").select("doc_id", "mark", "n", "size", "item_id", "at")
    # the hits of one document and item; rows that repeat add nothing to a set
    starts = hits.groupBy("doc_id", "mark", "n", "size", "item_id").agg(F.sort_array(F.collect_set("at")).alias("ats"))
    # a window is at least as long as the shared shingles, so similarity s to n shingles takes s n of them
    least = F.ceil(F.lit(similarity - 1e-9) * F.col("size")).cast("int")
    enough = F.filter("ats", lambda a, i: F.get("ats", i + least - 1) < a + F.col("size"))
    starts = starts.select("doc_id", "mark", "n", "size", "item_id", F.explode(enough).alias("at"))
    start = F.greatest(F.lit(0), F.least(F.col("at"), F.col("n") - F.col("size")))
    return starts.select("doc_id", "mark", "size", start.alias("start"), "item_id").distinct()


def _windows(marked: DataFrame, pairs: DataFrame, longest: int) -> DataFrame:
    """``(doc_id, mark, size, start, hs)``: the shingles of the windows in ``pairs``."""
    of = _small(cut_lineage(pairs.select(F.col("doc_id").alias("d"), F.col("mark").alias("m")).distinct()))
    held = marked.join(of, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), "left_semi").dropDuplicates(["doc_id", "mark"])
    held = held.select("doc_id", "mark", words(F.col("text")).alias("tokens")).select("doc_id", "mark", shingles(F.col("tokens")).alias("hs"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("hs") - 1) / CHUNK).cast("int")), lambda c: F.slice("hs", c * CHUNK + 1, F.lit(CHUNK + longest)))
    chunks = held.select("doc_id", "mark", F.posexplode_outer(cut).alias("chunk", "hs"))
    wanted = pairs.select("doc_id", "mark", "size", "start", F.floor(F.col("start") / CHUNK).cast("int").alias("chunk")).distinct()
    found = wanted.alias("w").join(chunks.alias("c"), _same("w", "c", "mark", "chunk"))
    return found.select("w.doc_id", "w.mark", "w.size", "w.start", F.slice("c.hs", F.col("w.start") - F.col("w.chunk") * CHUNK + 1, F.col("w.size")).alias("hs"))


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, mark, item_id, similarity, first_word, n_shingles)``: the best window of each document and item.

    ``mark`` is the XXH64 of the text, for rows whose ids aren't unique.
    """
    # words come in a projection of their own: inside a lambda they would be split again for each shingle; and a plain
    # explode would test its array in a filter below, with all that makes it copied there
    items = benchmark.select("item_id", words(F.col("text")).alias("ws")).select("item_id", shingles(F.col("ws")).alias("hs")).where(F.size("hs") > 0)
    items = cut_lineage(items.select("item_id", F.size("hs").alias("size"), F.explode("hs").alias("h")))
    longest = items.agg(F.max("size")).first()[0] or 0

    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    split = marked.select("doc_id", "mark", words(F.col("text")).alias("ws")).select("doc_id", "mark", shingles(F.col("ws")).alias("hs"))
    placed = split.select("doc_id", "mark", F.size("hs").alias("n"), F.posexplode_outer("hs").alias("at", "h"))
    pairs = cut_lineage(candidates(placed, items, similarity))
    windows = cut_lineage(_windows(marked, pairs, longest))

    prints = _simhash(windows.select("doc_id", "mark", "size", "start", F.explode("hs").alias("h")), "doc_id", "mark", "size", "start")
    item_prints = _simhash(items, "item_id").select("item_id", F.col("fp").alias("item_fp"), _blocks(radius).alias("b"))
    asked = pairs.alias("p").join(prints.alias("f"), _same("p", "f", "mark", "size", "start"))
    asked = asked.select("p.doc_id", "p.mark", "p.size", "p.start", "p.item_id", "f.fp").select("*", _blocks(radius).alias("b"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius
    met = asked.join(_small(cut_lineage(item_prints)), ["item_id", "b"]).where(near).select("doc_id", "mark", "size", "start", "item_id").distinct()

    read = met.alias("p").join(windows.alias("w"), _same("p", "w", "mark", "size", "start"))
    read = read.select("p.doc_id", "p.mark", "p.item_id", "p.start", "p.size", F.size("w.hs").alias("n"), F.explode("w.hs").alias("h"))
    keys = ["doc_id", "mark", "item_id", "start", "size", "n"]
    own = read.groupBy(*keys, "h").agg(F.count("*").alias("own"))
    theirs = _small(cut_lineage(items.groupBy("item_id", "h").agg(F.count("*").alias("theirs"))))
    scored = own.join(theirs, ["item_id", "h"]).groupBy(*keys).agg(F.sum(F.least("own", "theirs")).alias("shared"))
    scored = scored.withColumn("similarity", F.col("shared") / (F.col("size") + F.col("n") - F.col("shared"))).where(F.col("similarity") >= similarity)
    best = scored.groupBy("doc_id", "mark", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n")).alias("best"))
    return best.select("doc_id", "mark", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.back")).alias("first_word"), F.col("best.n").alias("n_shingles"))


def clean(docs: DataFrame, benchmark: DataFrame, **options: float) -> DataFrame:
    """``docs`` without those that hold an item."""
    found = leaks(docs, benchmark, **options).select(F.col("doc_id").alias("d"), F.col("mark").alias("m")).distinct()
    same = docs["doc_id"].eqNullSafe(found["d"]) & (F.xxhash64(docs["text"]) == found["m"])
    return docs.join(found, same, "left_anti")


# Windows that begin with a shingle of the item, without fingerprints: every pair that is similar enough is found.
ORACLE_SQL = rf"""
WITH doc_words AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS ws FROM documents),
item_words AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS ws FROM benchmark),
doc_sizes AS (SELECT doc_id, ws, CASE WHEN len(ws) = 0 THEN 0 ELSE greatest(1, len(ws) - {SHINGLE - 1}) END AS n FROM doc_words),
item_sizes AS (SELECT item_id, ws, CASE WHEN len(ws) = 0 THEN 0 ELSE greatest(1, len(ws) - {SHINGLE - 1}) END AS size FROM item_words),
ds AS (SELECT doc_id, n, t."at", array_to_string(ws[t."at" + 1 : t."at" + {SHINGLE}], ' ') AS h FROM doc_sizes, unnest(range(n)) AS t("at")),
bs AS (SELECT item_id, size, array_to_string(ws[t."at" + 1 : t."at" + {SHINGLE}], ' ') AS h FROM item_sizes, unnest(range(size)) AS t("at")),
bc AS (SELECT item_id, size, h, count(*) AS theirs FROM bs GROUP BY ALL),
hits AS (SELECT ds.doc_id, ds.n, ds."at", bc.item_id, bc.size FROM ds JOIN bc ON ds.h = bc.h),
starts AS (SELECT DISTINCT doc_id, item_id, size, n, greatest(0, least("at", n - size)) AS start FROM hits),
own AS (
    SELECT s.doc_id, s.item_id, s.size, s.n, s.start, ds.h, count(*) AS own
    FROM starts s JOIN ds ON ds.doc_id = s.doc_id AND ds."at" >= s.start AND ds."at" < s.start + s.size GROUP BY ALL),
scored AS (
    SELECT doc_id, item_id, start, least(size, n - start) AS n, sum(least(own, theirs)) AS shared, size
    FROM own JOIN bc USING (item_id, size, h) GROUP BY ALL),
ranked AS (SELECT *, shared / (size + n - shared) AS similarity FROM scored)
SELECT doc_id, item_id, round(similarity, 6) AS similarity, CAST(start AS INTEGER) AS first_word, CAST(n AS INTEGER) AS n_shingles
FROM ranked WHERE similarity >= {SIMILARITY}
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""
