"""Classes of near-duplicate texts: SimHash candidates, exact Jaccard similarity of word shingles.

Two texts are linked if the Jaccard similarity of the sets of their word shingles is at
least ``similarity``. At 0.8 their SimHash fingerprints differ in 10 of 64 bits on average
and seldom in over 20. Blocks of bits that agree within that radius are three bits long and
tell nothing apart, so fingerprints are dealt by bands of min-hashes of the same shingles:
16 bands of four miss a pair of similarity 0.8 once in 4600, of 0.85 once in 190 000.

First each member of a bucket is compared with two heads; these links make most of a large
group of copies one class. Then the buckets that hold several classes are searched by
the Gray-ordered index of ``simhash``, whose nodes also bound the sizes and the classes of
their members. Every pair within the radius that lies in two classes goes to the exact test,
none is left out for having nearer neighbours; the test is made in the bucket, where a link
found joins two classes at once, so no pairs are written, only links.

Buckets over ``hot_bucket`` are cut: their members are dealt to parts, and each two parts
meet in a bucket of their own. Buckets with the same members are searched once.

Edge cases: null and blank texts are similar to each other and to nothing else; a text of
fewer words than a shingle is one shingle; equal texts are one text; very long texts are
hashed whole (memory in proportion to the longest); ties don't arise, a class has no order;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from factloom.llm.gray import GrayIndex
from factloom.llm.shingles import majority_bits, shingle_hashes
from factloom.operators.components import connected_components
from factloom.runtime import cut_lineage

BANDS, BAND_SIZE = 16, 4
RADIUS = 20
HOT_BUCKET = 4_000
#: What a task searches at once, in rows and in bytes of packed texts; a bucket is never split by it.
ROWS_AT_ONCE, BYTES_AT_ONCE = 20_000, 16 << 20
#: A text with so many candidates is held against its whole bucket by an inverted index.
MANY = 8
#: Ids of texts to read again are broadcast up to so many rows, and joined by shuffle beyond.
BROADCAST_IDS = 500_000
HASHES_AT_ONCE = 4096
_FACTORS = np.array([xxhash.xxh64_intdigest(k.to_bytes(4, "little"), 42) | 1 for k in range(BANDS * BAND_SIZE)], np.uint64)


def bands(hashes: np.ndarray) -> list[int]:
    """Keys of the min-hash bands of a set of shingle hashes; one common key for the empty set."""
    if not len(hashes):
        return [0]
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    mixed = hashes ^ (hashes >> np.uint64(32))
    for at in range(0, len(mixed), HASHES_AT_ONCE):
        least = np.minimum(least, (mixed[at : at + HASHES_AT_ONCE, None] * _FACTORS).min(axis=0))
    rows = least.reshape(BANDS, BAND_SIZE)
    return [xxhash.xxh64_intdigest(r.tobytes(), i) - (1 << 63) for i, r in enumerate(rows)]


def summaries(marked: DataFrame, words: int) -> DataFrame:
    """``(doc_id, mark, fp, n, bands)`` of ``marked(doc_id, mark, text)``; the last three are null for a task's later copies of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            prints, sizes, keys = [], [], []
            for mark, text in zip(batch.column("mark").to_pylist(), batch.column("text"), strict=True):
                if mark in seen:
                    found = (None, None, None)
                else:
                    seen.add(mark)
                    distinct = np.unique(shingle_hashes(text.as_py(), words))
                    found = (majority_bits(distinct), len(distinct), bands(distinct))
                for column, value in zip((prints, sizes, keys), found, strict=True):
                    column.append(value)
            columns = [batch.column("doc_id"), batch.column("mark"), pa.array([None if p is None else p - (1 << 64 if p >> 63 else 0) for p in prints], pa.int64())]
            columns += [pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "fp", "n", "bands"])

    schema = marked.select("doc_id", "mark").schema.add("fp", "long").add("n", "integer").add("bands", ArrayType(LongType()))
    return marked.select("doc_id", "mark", "text").mapInArrow(run, schema)


def _fits(n: Column, m: Column, similarity: float) -> Column:
    return F.least(n, m) >= similarity * F.greatest(n, m) - 1e-6


def _read(held: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``held`` whose ids are in ``wanted(w)``."""
    wanted = cut_lineage(wanted.distinct())
    few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return held.join(F.broadcast(wanted) if few else wanted, F.col("id") == F.col("w"), "left_semi")


def verified(asked: DataFrame, held: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs ``asked(a, b)`` whose texts in ``held(id, packed)`` reach the similarity, as ``(src, dst)``."""
    read = cut_lineage(_read(held, asked.select(F.col("a").alias("w")).union(asked.select("b"))))
    both = asked.join(read.select(F.col("id").alias("a"), F.col("packed").alias("x")), "a")
    both = both.join(read.select(F.col("id").alias("b"), F.col("packed").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        last: dict[int, tuple[int, np.ndarray]] = {}

        def hashes(side: int, node: int, packed: bytes) -> np.ndarray:
            if side not in last or last[side][0] != node:
                last[side] = (node, np.unique(shingle_hashes(unpack(packed), words)))
            return last[side][1]

        for batch in batches:
            near = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                left, right = hashes(0, a, x), hashes(1, b, y)
                shared = len(np.intersect1d(left, right, assume_unique=True))
                near.append(shared >= similarity * (len(left) + len(right) - shared) - 1e-9)
            chosen = batch.filter(pa.array(near, pa.bool_()))
            yield pa.RecordBatch.from_arrays([chosen.column(0), chosen.column(1)], names=["src", "dst"])

    return cut_lineage(both.mapInArrow(run, "src long, dst long"))


def _open_buckets(members: DataFrame, hot_bucket: int) -> DataFrame:
    """``(key, id, fp, n, class)`` of the buckets of over two members in several classes, large ones cut; one bucket of those with equal members."""
    sizes = members.groupBy("key").agg(
        F.count("*").alias("c"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("sum"), F.min("class").alias("low"), F.max("class").alias("high")
    )
    sizes = sizes.where("low <> high AND c > 2").groupBy("c", "sum").agg(F.min("key").alias("k"))
    sizes = cut_lineage(sizes.select("k", F.ceil(F.col("c") / hot_bucket).cast("int").alias("parts")))
    found = members.join(sizes, F.col("key") == F.col("k")).select("key", "id", "fp", "n", "class", "parts")
    own = F.pmod(F.xxhash64("id", F.lit(5)), F.col("parts")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.xxhash64("key", F.least(own, j), F.greatest(own, j)))
    usual = found.where("parts = 1").select("key", "id", "fp", "n", "class")
    return usual.unionByName(found.where("parts > 1").select(F.explode(cells).alias("key"), "id", "fp", "n", "class"))


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole buckets from batches sorted by their first column."""
    parts: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        parts.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= ROWS_AT_ONCE or size >= BYTES_AT_ONCE:
            table = pa.Table.from_batches(parts)
            key = table.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield table.slice(0, cut)
            rest = table.slice(cut).combine_chunks()
            parts, rows, size = rest.to_batches(), rest.num_rows, rest.nbytes
    if parts:
        yield pa.Table.from_batches(parts)


def _index(table: pa.Table) -> GrayIndex:
    key, fp, size, kind = (table.column(c).to_numpy() for c in ("key", "fp", "n", "class"))
    return GrayIndex(key, fp.view(np.uint64), size, kind)


def _involved(buckets: DataFrame, radius: int, similarity: float) -> DataFrame:
    """The rows of ``buckets`` that are in any candidate pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_bucket(batches):
            index = _index(table)
            used = np.zeros(table.num_rows, bool)
            for x, y in index.pairs(radius, similarity):
                used[index.order[x]] = used[index.order[y]] = True
            yield from table.filter(pa.array(used)).to_batches()

    dealt = buckets.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, dealt.schema)


class Bucket:
    """Shingle sets of a bucket's members by place, and their common shingles."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.sizes, self.hashes = sets, np.array([len(s) for s in sets]), None

    def shared(self, x: int, others: np.ndarray) -> np.ndarray:
        own = self.sets[x]
        if len(others) < MANY:
            return np.array([len(np.intersect1d(own, self.sets[y], assume_unique=True)) for y in others.tolist()], np.int64)
        if self.hashes is None:
            every = np.concatenate(self.sets)
            order = np.argsort(every, kind="stable")
            self.hashes, self.owners = every[order], np.repeat(np.arange(len(self.sets)), self.sizes)[order]
        first, stop = np.searchsorted(self.hashes, own, "left"), np.searchsorted(self.hashes, own, "right")
        count = stop - first
        places = np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)
        return np.bincount(self.owners[places], minlength=len(self.sets))[others]


def _settled(table: pa.Table, words: int, radius: int, similarity: float) -> Iterator[tuple[int, int]]:
    """Links that join the classes of the buckets' members; every candidate pair of different classes is tested."""
    index, unpack = _index(table), zstandard.ZstdDecompressor().decompress
    node, packed = table.column("id").to_numpy()[index.order], table.column("packed").combine_chunks()
    _, place = np.unique(table.column("class").to_numpy()[index.order], return_inverse=True)
    root = np.arange(place.max() + 1)
    opens = np.flatnonzero(np.r_[True, index.bucket[1:] != index.bucket[:-1]])
    stops = np.r_[opens[1:], len(node)]
    known: dict[int, Bucket] = {}

    def bucket_of(k: int) -> Bucket:
        if k not in known:
            texts = (unpack(packed[int(index.order[i])].as_py()) for i in range(opens[k], stops[k]))
            known[k] = Bucket([np.unique(shingle_hashes(t, words)) for t in texts])
        return known[k]

    for x, y in index.pairs(radius, similarity):
        x, y = np.minimum(x, y), np.maximum(x, y)
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        for cut in np.split(np.arange(len(x)), np.flatnonzero(np.diff(x)) + 1):
            one, others = int(x[cut[0]]), y[cut]
            others = others[root[place[others]] != root[place[one]]]
            if not len(others):
                continue
            k = int(np.searchsorted(opens, one, "right")) - 1
            bucket = bucket_of(k)
            shared = bucket.shared(one - int(opens[k]), others - opens[k])
            either = bucket.sizes[one - opens[k]] + bucket.sizes[others - opens[k]] - shared
            for other in others[shared >= similarity * either - 1e-9].tolist():
                a, b = int(root[place[one]]), int(root[place[other]])
                if a != b:
                    root[root == max(a, b)] = min(a, b)
                    yield int(node[one]), int(node[other])


def _settle(buckets: DataFrame, held: DataFrame, words: int, radius: int, similarity: float) -> DataFrame:
    """Links ``(src, dst)`` between classes that share a bucket."""
    involved = cut_lineage(_involved(buckets, radius, similarity))
    read = _read(held, involved.select(F.col("id").alias("w"))).withColumnRenamed("id", "i")
    dealt = involved.join(read, F.col("id") == F.col("i")).select("key", "id", "fp", "n", "class", "packed").repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_bucket(batches):
            links = list(_settled(table, words, radius, similarity))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["src", "dst"])

    return cut_lineage(dealt.mapInArrow(run, "src long, dst long"))


def _with_classes(members: DataFrame, found: DataFrame) -> DataFrame:
    return members.join(found, F.col("id") == F.col("node"), "left").select("key", "id", "fp", "n", "c", F.coalesce("component", "id").alias("class"))


def classes(members: DataFrame, held: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = RADIUS, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """``(node, component)`` of the ids of ``members(key, id, fp, n, c)`` that are similar to another's; ``held(id, packed)`` has their texts."""
    # two heads a bucket: the member that meets most others (an original has more links than its edits), and one by hash
    now = members.withColumn("class", F.col("id"))
    whole = ["id", "fp", "n"]
    heads = now.groupBy("key").agg(
        F.min(F.struct(-F.col("c"), F.xxhash64("id"), *whole)).alias("x"), F.min(F.struct(F.xxhash64("id", F.lit(7)), *whole)).alias("y")
    )
    heads = heads.select(F.col("key").alias("k"), F.explode(F.array(*[F.struct(*[F.col(f"{h}.{c}") for c in whole]) for h in "xy"])).alias("h")).distinct()
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("h.fp"))) <= radius
    asked = now.join(heads, F.col("key") == F.col("k")).where((F.col("id") != F.col("h.id")) & _fits(F.col("n"), F.col("h.n"), similarity) & near)
    asked = cut_lineage(asked.select(F.least("id", "h.id").alias("a"), F.greatest("id", "h.id").alias("b")).distinct())
    found = _joined(verified(asked, held, words, similarity), None)
    buckets = _open_buckets(_with_classes(members, found), hot_bucket)
    return _joined(_settle(buckets, held, words, radius, similarity), found)


def _joined(links: DataFrame, found: DataFrame | None) -> DataFrame:
    if found is not None:
        links = links.unionByName(found.select(F.col("node").alias("src"), F.col("component").alias("dst")))
    return cut_lineage(connected_components(links))


def mark(text: str = "text") -> Column:
    """Digest of a text, 16 bytes; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def distinct_texts(docs: DataFrame, words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of ``docs(doc_id, text)``: ``(id, mark, first)`` per distinct text, ``(key, id, fp, n, c)`` per band that another text has too (``c``: members that the text meets, over all its bands), and ``(id, packed)``, these texts.

    ``first`` is the row that stands for the text: the least id, null ids last.
    """
    marked = docs.select("doc_id", mark().alias("mark"), "text")
    rows = cut_lineage(summaries(marked, words))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first")
    summary = F.first(F.when(F.col("n").isNotNull(), F.struct("fp", "n", "bands")), ignorenulls=True).alias("s")
    texts = cut_lineage(rows.groupBy("mark").agg(first, summary).select(F.monotonically_increasing_id().alias("id"), "mark", "first", "s.*"))
    keys = texts.select(F.explode("bands").alias("key"), "id", "fp", "n")
    shared = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select(F.col("key").alias("k"), "c")
    members = cut_lineage(keys.join(shared, F.col("key") == F.col("k")).drop("k"))
    ids = members.groupBy(F.col("id").alias("i")).agg(F.sum("c").alias("sum"))
    members = cut_lineage(members.drop("c").join(ids, F.col("id") == F.col("i")).select("key", "id", "fp", "n", F.col("sum").alias("c")))
    wanted = cut_lineage(texts.join(ids, F.col("id") == F.col("i")).select("id", F.col("mark").alias("m"), F.col("first.doc_id").alias("d")))
    if wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    read = marked.join(wanted, (F.col("mark") == F.col("m")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("id", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            packed = [press((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["id", "packed"])

    held = cut_lineage(read.mapInArrow(pack, "id long, packed binary").dropDuplicates(["id"]))
    return texts.select("id", "mark", "first"), members, held
