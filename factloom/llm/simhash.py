"""SimHash near-duplicate classes with a Gray-ordered hierarchical index.

Fingerprints of whole texts are reduced to their distinct values. Pairs within the
radius agree on one of ``radius + 1`` bit blocks, so distinct values are dealt by block
value; within a bucket they are sorted by Gray rank, nodes over runs of neighbours keep
the bits that all their members share, and pairs of nodes are dropped or accepted whole
by the differences that those bits already show. A bucket sends a star per class rather
than its pairs.

Edge cases: a null or blank text has fingerprint zero and is linked like any other; null
``doc_id`` rows are kept, and a class without any id has a null id; repeated rows are
rows of one class; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm import similar
from factloom.llm.gray import GrayIndex
from factloom.llm.shingles import majority_bits, shingle_hashes
from factloom.operators.components import connected_components
from factloom.runtime import cut_lineage

#: A block value with more distinct fingerprints is dealt again by blocks of its other bits.
HOT_BUCKET = 20_000


def text_fingerprint(text: str | None, words: int) -> int:
    """Bit i is set if over half of the word shingles' XXH64 (seed 42) have it."""
    return majority_bits(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """``docs`` without text, with ``fp``: the text's fingerprint as a signed long."""
    rest = [c for c in docs.columns if c != "text"]
    slim = docs.select(*rest, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([text_fingerprint(t.as_py(), words) for t in batch.column("text")], np.uint64)
            columns = [batch.column(c) for c in rest] + [pa.array(found.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=[*rest, "fp"])

    schema = slim.drop("text").schema.add("fp", "long", False)
    return slim.mapInArrow(run, schema)


def _bits(column: str, low: int, width: int) -> Column:
    return F.shiftrightunsigned(F.col(column), low).bitwiseAND(F.lit((1 << width) - 1))


def _blocks(total: int, parts: int) -> list[tuple[int, int]]:
    cuts = [total * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def links(values: DataFrame, radius: int, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Stars ``(src, dst)`` whose components are those of all pairs of ``values(fp)`` within ``radius``."""
    parts = _blocks(64, radius + 1)
    keyed = values.select(
        "fp", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), _bits("fp", *p).alias("v")) for i, p in enumerate(parts)])).alias("k")
    ).select("fp", F.col("k.i").alias("i"), F.xxhash64("k.i", "k.v").alias("key"))
    hot = keyed.groupBy("key").count().where(F.col("count") > hot_bucket).select("key")
    if not hot.isEmpty():
        hot = cut_lineage(hot)
        finer = keyed.join(hot, "key", "left_semi")
        cases = []
        for i, (low, width) in enumerate(parts):
            rest = F.when(F.lit(low == 0), F.lit(0)).otherwise(_bits("fp", 0, low) if low else F.lit(0))
            above = F.shiftrightunsigned("fp", low + width) if low + width < 64 else F.lit(0).cast("long")
            packed = F.shiftleft(above, low).bitwiseOR(rest.cast("long"))
            cases.append((i, packed, 64 - width))
        split = None
        for i, packed, left in cases:
            own = finer.where(F.col("i") == i).withColumn("rest", packed)
            subs = [F.xxhash64("key", F.lit(j), _bits("rest", *p)) for j, p in enumerate(_blocks(left, radius + 1))]
            own = own.select("fp", F.explode(F.array(*subs)).alias("key"))
            split = own if split is None else split.unionByName(own)
        keyed = keyed.join(hot, "key", "left_anti").select("fp", "key").unionByName(split)
    dealt = keyed.select("key", "fp").repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_v, held = [], [], 0
        for batch in batches:
            held_k.append(batch.column(0).to_numpy(zero_copy_only=False))
            held_v.append(batch.column(1).to_numpy(zero_copy_only=False))
            held += batch.num_rows
            if held >= 200_000:
                key, value = np.concatenate(held_k), np.concatenate(held_v)
                cut = int(np.searchsorted(key, key[-1]))
                if cut:
                    yield from _linked(key[:cut], value[:cut], radius)
                held_k, held_v, held = [key[cut:]], [value[cut:]], len(key) - cut
        if held:
            yield from _linked(np.concatenate(held_k), np.concatenate(held_v), radius)

    return dealt.mapInArrow(run, "src long, dst long")


def _linked(key: np.ndarray, value: np.ndarray, radius: int) -> Iterator[pa.RecordBatch]:
    index = GrayIndex(key, value.astype(np.int64).view(np.uint64))
    label = index.classes(radius)
    x = np.flatnonzero(label != np.arange(len(label)))
    y = label[x]
    if len(x):
        signed = index.values.view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(signed[x]), pa.array(signed[y])], names=["src", "dst"])


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """``(doc_id, fp, component_id)`` per row of ``docs``; a class is named by its least ``doc_id``."""
    prints = cut_lineage(fingerprints(docs.select("doc_id", "text"), words))
    return classes(prints, radius, hot_bucket)


def classes(prints: DataFrame, radius: int, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """``prints(doc_id, fp)`` with ``component_id``.

    A fingerprint enters the components as (its least id, itself), ids before none, so that a
    component's least member names it and no class is gathered to find its name.
    """
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    node = F.struct(F.col("least").isNull().alias("none"), "least", "fp")
    ends = [distinct.select(F.col("fp").alias(e), node.alias(f"{e}_node")) for e in ("src", "dst")]
    met = links(distinct.select("fp"), radius, hot_bucket).join(ends[0], "src").join(ends[1], "dst")
    found = connected_components(met.select(F.col("src_node").alias("src"), F.col("dst_node").alias("dst")))
    linked = found.select(F.col("node.fp").alias("f"), F.col("component.least").alias("named"), F.lit(True).alias("linked"))
    of = distinct.join(linked, F.col("fp") == F.col("f"), "left").select("fp", F.when(F.col("linked"), F.col("named")).otherwise(F.col("least")).alias("component_id"))
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")


def hex_word(column: str) -> Column:
    """A long as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each class of near-duplicates: the least id's (null ids last).

    Equal texts are one text from the start. Two texts are linked if the Jaccard similarity of
    the sets of their word shingles is at least ``similarity``; ``similar`` says how pairs are
    found. Texts that no link joins to an earlier one stay.
    """
    columns = docs.columns
    texts, members, held = similar.distinct_texts(docs.select("doc_id", "text"), words)
    found = similar.classes(members, held, words, similarity)
    rooted = texts.join(found, F.col("id") == F.col("node"), "left").select("first", "mark", F.coalesce("component", "id").alias("root"))
    chosen = rooted.groupBy("root").agg(F.min(F.struct("first", "mark")).alias("c")).select(F.col("c.first.doc_id").alias("d"), F.col("c.mark").alias("m"))
    chosen = cut_lineage(chosen)
    keys = docs.select("doc_id", similar.mark().alias("mark"))
    gone = keys.join(chosen, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), "left_anti")
    gone = cut_lineage(gone.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__of")).distinct())
    out = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (similar.mark() == F.col("__of")), "left_anti")
    if not keys.groupBy("doc_id", "mark").count().where("count > 1").isEmpty():
        out = out.withColumn("__mark", similar.mark()).dropDuplicates(["doc_id", "__mark"])
    return out.select(*columns)
