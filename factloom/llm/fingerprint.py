"""Document fingerprints by invertible Bloom lookup sketches.

A text is cut into paragraphs (its lines; a line of over ``LONG_LINE`` characters counts
sentence by sentence). Their digests go to one cell of each of three sub-tables of a sketch.
A paragraph that occurs c times has a digest for its 1st, 2nd, 4th ... occurrence and, if c
is no power of two, one for c, so that repeats are seen and cost little.

A fingerprint is the number of digests and the cells, in base 64. Sub-tables have a power of
two of cells, the least from a bound on the number of digests up with which the sketch, peeled
on its own, gives all its digests back: so sets can always be had from fingerprints alone.

Two fingerprints are compared by subtracting cells; the larger is folded to the smaller's
size first. Peeling recovers the digests that differ, with the side that has them. Where it
fails, the comparison is repeated with what each fingerprint yields at its own size, which
can't fail. The likeness is that of the two sets, shared over all digests.

Edge cases: a null text counts as empty; two empty texts have likeness 1, an empty and another
one 0; repeated rows stay; rows follow each other by ``doc_id`` and, where that is equal, by a
hash of the text and the text; null ids come first; the last row is followed by the first, a
single row by itself; a very long text takes memory in proportion to its distinct paragraphs;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG_LINE = 320
SENTENCE = re.compile(r"[^.!?]+[.!?]*|[.!?]+")
LEAST_THIRD = 4
#: Cells that one round of peeling holds at most (beyond one row's own).
CELLS_AT_ONCE = 1 << 21
BUCKET_BYTES = 4 << 20
#: Ranges of ids; beyond this number ranges grow. A range is streamed in order, never held.
MAX_BUCKETS = 20_000
CELL = np.dtype([("count", "<i2"), ("keys", "<u8"), ("check", "<u4")])
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_OFFSETS = [np.uint64(0x9E3779B97F4A7C15 * j & 0xFFFFFFFFFFFFFFFF) for j in (1, 2, 3)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def paragraphs(text: str) -> list[str]:
    """The pieces of a text; no character but line ends is left out."""
    out = []
    for line in text.split("\n") if text else ():
        out += [line] if len(line) <= LONG_LINE else SENTENCE.findall(line)
    return out


def digests(text: str) -> np.ndarray:
    """Sorted digests of the paragraphs and of how often they occur."""
    out = set()
    for piece, count in Counter(paragraphs(text)).items():
        kth = 1
        while kth <= count:
            out.add(xxhash.xxh64_intdigest(piece.encode("utf-8", "surrogatepass"), kth))
            kth *= 2
        if 2 * count != kth:
            out.add(xxhash.xxh64_intdigest(piece.encode("utf-8", "surrogatepass"), count))
    return np.array(sorted(out), np.uint64)


class Sketches:
    """Sketches of many key sets, a row of cells each; ``third`` is a power of two."""

    def __init__(self, sets: list[np.ndarray], third: int):
        self.third = third
        rows, width = len(sets), 3 * third
        keys = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        row = np.repeat(np.arange(rows), [len(s) for s in sets])
        self.count = np.zeros(rows * width, np.int64)
        self.keys = np.zeros(rows * width, np.uint64)
        self.check = np.zeros(rows * width, np.uint64)
        self._toggle(row, keys, 1)

    @classmethod
    def of(cls, third: int, count: np.ndarray, keys: np.ndarray, check: np.ndarray) -> Sketches:
        out = cls([], third)
        out.count, out.keys, out.check = count, keys, check
        return out

    def cells(self, row: np.ndarray, keys: np.ndarray) -> np.ndarray:
        places = [(_mix(keys + offset) & np.uint64(self.third - 1)) + np.uint64(j * self.third) for j, offset in enumerate(_OFFSETS)]
        return (row * (3 * self.third))[None, :] + np.array(places).astype(np.int64)

    def _toggle(self, row: np.ndarray, keys: np.ndarray, sign: np.ndarray | int) -> None:
        check = _mix(keys ^ _GOLD) & np.uint64(0xFFFFFFFF)
        for place in self.cells(row, keys):
            np.add.at(self.count, place, sign)
            np.bitwise_xor.at(self.keys, place, keys)
            np.bitwise_xor.at(self.check, place, check)

    def __sub__(self, other: Sketches) -> Sketches:
        return Sketches.of(self.third, self.count - other.count, self.keys ^ other.keys, self.check ^ other.check)

    def fold(self, third: int) -> Sketches:
        """The same sets in sub-tables of ``third`` cells."""
        shape = (-1, 3, self.third // third, third)
        xor = [np.bitwise_xor.reduce(x.reshape(shape), axis=2).ravel() for x in (self.keys, self.check)]
        return Sketches.of(third, self.count.reshape(shape).sum(axis=2).ravel(), *xor)

    def rows(self, which: np.ndarray) -> Sketches:
        return Sketches.of(self.third, *(x.reshape(-1, 3 * self.third)[which].ravel() for x in (self.count, self.keys, self.check)))

    def copy(self) -> Sketches:
        return Sketches.of(self.third, self.count.copy(), self.keys.copy(), self.check.copy())

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows, keys and signs of the recovered digests, and whether the row's cells all ended empty; uses the sketch up."""
        width = 3 * self.third
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        look = np.flatnonzero(np.abs(self.count) == 1)
        rounds = 64 + 2 * width  # a false match could otherwise toggle for ever
        while len(look) and rounds:
            rounds -= 1
            look = look[(np.abs(self.count[look]) == 1) & (self.check[look] == _mix(self.keys[look] ^ _GOLD) & np.uint64(0xFFFFFFFF))]
            if not len(look):
                break
            row, keys, sign = look // width, self.keys[look], self.count[look]
            order = np.lexsort((keys, row))
            first = np.r_[True, (row[order][1:] != row[order][:-1]) | (keys[order][1:] != keys[order][:-1])]
            one = order[first]
            row, keys, sign = row[one], keys[one], sign[one]
            found.append((row, keys, sign))
            self._toggle(row, keys, -sign)
            look = np.unique(self.cells(row, keys))
        full = (self.count != 0) | (self.keys != 0) | (self.check != 0)
        none = np.zeros(0, np.int64)
        rows, keys, signs = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none.astype(np.uint64), none)
        return rows, keys, signs, ~full.reshape(-1, width).any(axis=1)


def least_third(size: int) -> int:
    """Cells of a sub-table to begin with: half as many as digests, and two."""
    third = LEAST_THIRD
    while third < size // 2 + 2:
        third *= 2
    return third


def _chunks(rows: list[int], third: int) -> Iterator[list[int]]:
    step = max(1, CELLS_AT_ONCE // (3 * third))
    for at in range(0, len(rows), step):
        yield rows[at : at + step]


class Prints:
    """Fingerprints of many sets, tabled by size: a set's sub-table cells and its row among those of that size."""

    def __init__(self) -> None:
        self.sizes: np.ndarray = np.zeros(0, np.int64)
        self.third: np.ndarray = np.zeros(0, np.int64)
        self.row: np.ndarray = np.zeros(0, np.int64)
        self.tables: dict[int, Sketches] = {}

    def _table(self, third: int, parts: list[tuple[np.ndarray, Sketches]]) -> None:
        at = np.concatenate([i for i, _ in parts])
        self.third[at], self.row[at] = third, np.arange(len(at))
        self.tables[third] = Sketches.of(third, *(np.concatenate([getattr(x, name) for _, x in parts]) for name in ("count", "keys", "check")))

    @classmethod
    def of(cls, sets: list[np.ndarray]) -> Prints:
        """Each set at the least size from which it can be had back."""
        out = cls()
        out.sizes, out.third, out.row = np.array([len(s) for s in sets], np.int64), np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
        todo: dict[int, list[int]] = {}
        for i, s in enumerate(sets):
            todo.setdefault(least_third(len(s)), []).append(i)
        while todo:
            third, parts = min(todo), []
            for part in _chunks(todo.pop(third), third):
                made = Sketches([sets[i] for i in part], third)
                *_, fine = made.copy().peel()
                parts.append((np.array(part)[fine], made.rows(np.flatnonzero(fine))))
                if not fine.all():
                    todo.setdefault(2 * third, []).extend(np.array(part)[~fine].tolist())
            out._table(third, parts)
        return out

    @classmethod
    def load(cls, raw: list[bytes]) -> Prints:
        out = cls()
        out.sizes = np.array([struct.unpack_from("<I", p)[0] for p in raw], np.int64)
        sizes = np.array([1 << p[4] - 1 for p in raw], np.int64)
        out.third, out.row = sizes.copy(), np.zeros(len(raw), np.int64)
        for third in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == third)
            cells = np.frombuffer(b"".join(raw[i][5:] for i in at.tolist()), CELL)
            out._table(third, [(at, Sketches.of(third, cells["count"].astype(np.int64), cells["keys"].astype(np.uint64), cells["check"].astype(np.uint64)))])
        return out

    def raw(self) -> list[bytes]:
        packed = {}
        for third, table in self.tables.items():
            cells = np.zeros(len(table.count), CELL)
            cells["count"], cells["keys"], cells["check"] = table.count, table.keys, table.check
            packed[third] = cells.tobytes()
        out = []
        for size, third, row in zip(self.sizes.tolist(), self.third.tolist(), self.row.tolist(), strict=True):
            width = 3 * third * CELL.itemsize
            out.append(struct.pack("<IB", size, third.bit_length()) + packed[third][row * width : (row + 1) * width])
        return out

    def recovered(self, which: np.ndarray) -> list[np.ndarray]:
        """The digests of each of these fingerprints."""
        out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(which)
        sizes = self.third[which]
        for third in np.unique(sizes).tolist():
            for part in _chunks(np.flatnonzero(sizes == third).tolist(), third):
                row, keys, _, fine = self.tables[third].rows(self.row[which[part]]).peel()
                assert fine.all()
                order = np.lexsort((keys, row))
                ends = np.searchsorted(row[order], np.arange(len(part) + 1))
                for k, i in enumerate(part):
                    out[i] = keys[order[ends[k] : ends[k + 1]]]
        return out

    def differences(self, left: np.ndarray, right: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each two fingerprints the digests that only the left and only the right one has."""
        none = np.zeros(0, np.uint64)
        out = [(none, none)] * len(left)
        apart = np.flatnonzero(left != right)
        sizes = np.stack([self.third[left[apart]], self.third[right[apart]]], axis=1)
        kinds, which = np.unique(sizes, axis=0, return_inverse=True)
        failed: list[int] = []
        for kind, (own, other) in enumerate(kinds.tolist()):
            third = min(own, other)
            for part in _chunks(apart[which == kind].tolist(), max(own, other)):
                part = np.array(part)
                a, b = self.tables[own].rows(self.row[left[part]]).fold(third), self.tables[other].rows(self.row[right[part]]).fold(third)
                row, keys, sign, fine = (a - b).peel()
                order = np.lexsort((keys, row))
                row, keys, sign = row[order], keys[order], sign[order]
                ends = np.searchsorted(row, np.arange(len(part) + 1))
                for k, i in enumerate(part.tolist()):
                    if fine[k]:
                        mine, way = keys[ends[k] : ends[k + 1]], sign[ends[k] : ends[k + 1]]
                        out[i] = mine[way > 0], mine[way < 0]
                    else:
                        failed.append(i)
        again = np.unique(np.concatenate([left[failed], right[failed]])) if failed else np.zeros(0, np.int64)
        sets = {i: set(keys.tolist()) for i, keys in zip(again.tolist(), self.recovered(again), strict=True)}
        for i in failed:
            x, y = sets[int(left[i])], sets[int(right[i])]
            out[i] = np.array(sorted(x - y), np.uint64), np.array(sorted(y - x), np.uint64)
        return out

    def likeness(self, left: np.ndarray, right: np.ndarray, apart: list[tuple[np.ndarray, np.ndarray]]) -> list[float]:
        """Shared over all digests, from the numbers in the fingerprints and what differs."""
        shared = self.sizes[left] - np.array([len(x) for x, _ in apart], np.int64)
        either = self.sizes[left] + self.sizes[right] - shared
        return np.where(either > 0, shared / np.maximum(either, 1), 1.0).tolist()


def _hex(keys: np.ndarray) -> str:
    return ",".join(f"{k:016x}" for k in keys.tolist())


def edit(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the following text's beginning."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _rows(ids: list, texts: list[str], following: list[str]) -> tuple[list, ...]:
    edited = [edit(a, b) for a, b in zip(texts, following, strict=True)]
    every = list(dict.fromkeys([*texts, *edited, *following]))
    place = {t: i for i, t in enumerate(every)}
    own, new, after = (np.array([place[t] for t in x]) for x in (texts, edited, following))
    prints = Prints.of([digests(t) for t in every])
    changed = prints.differences(own, new)
    raw = [base64.b64encode(p).decode() for p in prints.raw()]
    return (
        ids,
        [len(t) for t in texts],
        [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
        [raw[i] for i in own],
        [raw[i] for i in new],
        prints.likeness(own, new, changed),
        prints.likeness(own, after, prints.differences(own, after)),
        [_hex(x) for x, _ in changed],
        [_hex(y) for _, y in changed],
    )


def with_next(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Rows ``(bucket, head, doc_id, h, text)`` of ``docs``, dealt to ranges; each range ends with the next one's first row (``head``).

    Null ids are dealt by ranges of the text's hash, others by ranges of the id, of about
    ``bucket_bytes`` each (more where there would be over ``MAX_BUCKETS``); so only that many
    splitters and range numbers reach the driver.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    size = F.octet_length("text").cast("long") + 16
    total, lost = rows.agg(F.sum(size), F.sum(F.when(F.col("doc_id").isNull(), size))).first()
    share = max(bucket_bytes, (total or 0) // MAX_BUCKETS + 1)
    nulls, parts = ((lost or 0) // share + 1 if lost else 0), ((total or 0) - (lost or 0)) // share + 1
    cuts: list = []
    if parts > 1:
        shares = ",".join(f"{i / parts:.6f}" for i in range(1, parts))
        cuts = sorted(set(rows.agg(F.expr(f"approx_percentile(doc_id, array({shares}), {max(10_000, 10 * parts)})")).first()[0]))
    points = np.array(cuts)

    @F.pandas_udf("int")
    def dealt(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(points, ids.fillna(0).to_numpy(), side="right") + nulls, dtype="int32")

    by_hash = F.floor((F.shiftright("h", 32) + (1 << 31)) * nulls / (1 << 32)).cast("int")
    by_id = dealt("doc_id") if len(points) else F.lit(nulls)
    spread = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), by_hash).otherwise(by_id))
    firsts = spread.groupBy("bucket").agg(F.min(F.struct("doc_id", "h")).alias("f")).orderBy("bucket").collect()
    if not firsts:
        return spread.select("bucket", F.lit(False).alias("head"), "doc_id", "h", "text")
    owners = [r["bucket"] for r in firsts]
    marks = [(b, r["f"]["doc_id"], r["f"]["h"], owners[i - 1]) for i, (b, r) in enumerate(zip(owners, firsts, strict=True))]
    marks = docs.sparkSession.createDataFrame(marks, f"b int, i {dict(rows.dtypes)['doc_id']}, k long, before int")
    same = (F.col("bucket") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("k"))
    heads = spread.join(F.broadcast(marks), same).groupBy("before", "doc_id", "h").agg(F.min("text").alias("text"))
    heads = heads.select(F.col("before").alias("bucket"), F.lit(True).alias("head"), "doc_id", "h", "text")
    return spread.select("bucket", F.lit(False).alias("head"), "doc_id", "h", "text").unionByName(heads)


def fingerprint(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Fingerprints of every text and its edited text, their likeness, and the digests that the edit removed and added; see the module."""
    dealt = with_next(docs, bucket_bytes).repartition("bucket").sortWithinPartitions("bucket", "head", "doc_id", "h", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                head, ids, texts = part.column(1).to_pylist(), part.column(2), part.column(4).to_pylist()
                rows = list(zip(head, ids.to_pylist(), texts, strict=True))
                rows, last = ([last] if last else []) + rows, rows[-1]
                pairs = [(a[1], a[2], b[2]) for a, b in zip(rows, rows[1:], strict=False) if not a[0]]
                if pairs:
                    found = _rows(*map(list, zip(*pairs, strict=True)))
                    yield pa.RecordBatch.from_arrays([pa.array(found[0], ids.type), *map(pa.array, found[1:])], names=schema.fieldNames())

    schema = docs.select("doc_id").schema.add("n_chars", "long")
    for name in ("edited_sha256", "fingerprint", "edited_fingerprint"):
        schema = schema.add(name, "string")
    for name in ("near_edited", "near_next"):
        schema = schema.add(name, "double")
    return dealt.mapInArrow(run, schema.add("removed", "string").add("added", "string"))
