"""Repeated-substring removal by a distributed merge of sparse suffix runs.

A byte goes if a ``length``-byte string that covers it also starts anywhere else. Sorting
every suffix would move hundreds of bytes per byte of text, so the suffix array is sparse:
each ``length``-byte window names the position of its least ``core``-byte hash as anchor,
and equal windows name equal places. Only anchors whose core hash occurs twice go on.

1. Anchors and the counts of their core hashes (partial sums before the shuffle).
2. Texts with repeated anchors: each task sorts the contexts of its anchors (the suffix,
   then the bytes before it, nearest first), drops repeats, front-codes the run by common
   prefixes and sends it to ranges of the core hash.
3. A loser tree merges the runs of a range; it keeps the common prefix of each loser with
   the last winner, so known prefixes are never compared again. The common prefixes that
   the merge yields, with those of the sorted left contexts, give for each shift of the
   window the classes of equal windows, hence the covered stretch around each anchor.
4. Stretches are united per document and cut out.

Core hashes with over ``hot`` anchors are refined: their windows are dealt in narrow groups
of shifts by a core that is nearly the whole window, so that equal strings collapse in each
run and no range gathers a large group. Contexts that occur twice in one task are settled
there; only one of them travels, without its positions.

In a stretch that repeats itself every few bytes (blank runs, ruled lines) each period would
be an anchor. Of these only the ones near its ends stay, and so many between that each window
still holds one: a window in the middle equals the one that lies as far on as the anchors do.

Edge cases: null and empty texts have nothing to remove; repeated rows are documents of
their own (all their long strings occur twice); null ids are kept and matched as equal; very
long texts are read in pieces, and stretches of short period cost few anchors; ties between
least hashes all count as anchors, so that equal windows name equal places; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.runtime import cut_lineage

WINDOW_STARTS_AT_ONCE = 1 << 20
RUN_BYTES = 48 << 20
RANGE_BYTES = 16 << 20
HOT = 10_000
HOT_SPAN = 8
ANCHORS_AT_ONCE = 20_000
_BASE = 0x9E3779B97F4A7C15


def core_length(length: int) -> int:
    """Bytes that are hashed: the largest power of two within two fifths of the window."""
    return 1 << max(0, (length * 2 // 5).bit_length() - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _slide(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """``best`` over each stretch of ``width`` values."""
    done = 1
    while done * 2 <= width:
        x, done = best(x[:-done], x[done:]), done * 2
    return best(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def anchors(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and core hashes of the anchors of texts that lie end to end in ``data``."""
    core = core_length(length)
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, done = _BYTE[data], 1
    power = np.uint64(_BASE | 1)
    while done < core:
        h = h[:-done] * power + h[done:]
        done *= 2
        power = np.uint64(int(power) * int(power) & 0xFFFFFFFFFFFFFFFF)
    h = _mix(h) | np.uint64(1)
    width = length - core + 1
    least = _slide(h, width, np.minimum)
    ends = np.r_[starts[1:], len(data)]
    steps = np.zeros(len(least) + 1, np.int32)  # windows that cross a text's end don't count
    np.add.at(steps, np.minimum(np.maximum(ends - length + 1, starts), len(least)), 1)
    np.add.at(steps, np.minimum(ends, len(least)), -1)
    least[np.cumsum(steps[:-1]) > 0] = 0
    none = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(h == _slide(np.concatenate([none, least, none]), width, np.maximum)[: len(h)])
    at = at[_thinned(at, h[at], np.searchsorted(starts, at, side="right"), length)]
    return at, h[at]


def _thinned(at: np.ndarray, h: np.ndarray, text: np.ndarray, length: int) -> np.ndarray:
    """Which anchors stay: of stretches of equal ones at equal distances, no longer than the core, those near the ends and some between."""
    stay = np.ones(len(at), bool)
    if len(at) < 3:
        return stay
    core = core_length(length)
    apart = np.diff(at)
    alike = (h[1:] == h[:-1]) & (text[1:] == text[:-1]) & (apart <= core)
    goes_on = alike[1:] & alike[:-1] & (apart[1:] == apart[:-1])  # the anchor between two equal distances
    opens = np.flatnonzero(goes_on & ~np.r_[False, goes_on[:-1]])
    shuts = np.flatnonzero(goes_on & ~np.r_[goes_on[1:], False]) + 2
    for first, last in zip(opens.tolist(), shuts.tolist(), strict=True):
        low = int(np.searchsorted(at, at[first] + 2 * length))
        high = int(np.searchsorted(at, at[last] - 2 * length, side="right"))
        if low < high:
            every = max(1, (length - core) // int(apart[first]))
            middle = np.arange(low, high)
            stay[middle[(middle - first) % every != 0]] = False
    return stay


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def _pieces(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int]]:
    """(row, first byte, end byte): texts, the longest cut into pieces that share ``length - 1`` bytes."""
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        while b - a >= length:
            stop = min(b, a + WINDOW_STARTS_AT_ONCE + length - 1)
            yield row, a, stop
            a = stop - length + 1 if stop < b else b


def text_anchors(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, position in the text and core hash of every anchor of a column of texts."""
    data, offsets = _binary(column)
    rows, places, hashes, group, size = [], [], [], [], 0

    def close() -> None:
        parts = [data[a:b] for _, a, b in group]
        starts = np.cumsum([0] + [len(p) for p in parts])[:-1]
        at, h = anchors(np.concatenate(parts), starts, length)
        k = np.searchsorted(starts, at, side="right") - 1
        row = np.array([r for r, _, _ in group])[k]
        rows.append(row)
        places.append(at - starts[k] + np.array([a for _, a, _ in group])[k] - offsets[row])
        hashes.append(h)

    for piece in _pieces(offsets, length):
        group.append(piece)
        size += piece[2] - piece[1]
        if size >= WINDOW_STARTS_AT_ONCE:
            close()
            group, size = [], 0
    if group:
        close()
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row, place, h = np.concatenate(rows), np.concatenate(places), np.concatenate(hashes)
    return row, place, h


def _common(rows: np.ndarray) -> np.ndarray:
    """Common prefix of each row of bytes with the one before it."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def _sorted(rows: np.ndarray) -> np.ndarray:
    return np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")


class Contexts:
    """Contexts of anchors that one task gathers for a run; ``span`` is the number of shifts less one."""

    def __init__(self, length: int, span: int, ranges: int, shift: int):
        self.length, self.span, self.ranges, self.shift = length, span, ranges, shift
        self.parts: list[tuple] = []
        self.size = 0

    def add(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, at: np.ndarray, core: np.ndarray | None, refs: np.ndarray) -> None:
        """Anchors at byte ``at`` of texts that lie in ``data`` from ``begin`` to ``end``."""
        right = at[:, None] + np.arange(self.length)
        left = at[:, None] - 1 - np.arange(self.span)
        index = np.concatenate([right, left], axis=1)
        fine = (index >= begin[:, None]) & (index < end[:, None])
        rows = np.where(fine, data[np.clip(index, 0, max(0, len(data) - 1))], 0).astype(np.uint8)
        room = np.stack([np.minimum(end - at, self.length), np.minimum(at - begin, self.span)], axis=1).astype(np.uint16)
        if core is None:
            size = self.length - self.span
            core = np.array([xxhash.xxh64_intdigest(r[:size].tobytes()) for r in rows], np.uint64)
        target = (core % np.uint64(self.ranges)).astype(np.int32) + self.shift
        self.parts.append((rows, room, target, refs))
        self.size += rows.nbytes

    def run(self) -> Iterator[tuple[int, bytes]]:
        """The sorted front-coded run as (range, packed) rows; what it can settle has range -1."""
        width = self.length + self.span
        # the room is part of the key: texts may hold the byte that pads
        key = np.empty((sum(len(p[0]) for p in self.parts), width + 8), np.uint8)
        room, target, refs = (np.concatenate([p[i] for p in self.parts]) for i in (1, 2, 3))
        at = 0
        while self.parts:
            part = self.parts.pop(0)[0]
            key[at : at + len(part), 4:-4] = part
            at += len(part)
        self.size = 0
        key[:, :4] = target.astype(">u4").view(np.uint8).reshape(-1, 4)
        key[:, -4:] = room.astype(">u2").view(np.uint8).reshape(-1, 4)
        order = _sorted(key)
        key, room, target, refs = key[order], room[order], target[order], refs[order]
        fresh = np.r_[True, (key[1:] != key[:-1]).any(axis=1)]
        group = np.cumsum(fresh) - 1
        count = np.bincount(group)
        if (again := count[group] > 1).any():
            # every whole window of these contexts occurs twice
            low, high = _shifts_within(room[again], self.length, self.span)
            some = low <= high
            yield -1, _pack_found(refs[again][some], low[some], high[some], self.length)
        heads = np.flatnonzero(fresh)
        rows, room, target, refs = key[heads, 4:-4], room[heads], target[heads], refs[heads]
        del key
        cuts = np.flatnonzero(np.r_[True, target[1:] != target[:-1], True])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield int(target[a]), _pack_run(rows[a:b], room[a:b], refs[a:b], count[a:b] > 1)


def _shifts_within(room: np.ndarray, length: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and most shift whose window lies in the text."""
    return np.maximum(0, length - room[:, 0].astype(np.int64)), np.minimum(span, room[:, 1].astype(np.int64))


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=5).compress(head + b"".join(a.tobytes() for a in arrays))


def _unpack(packed: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes, at, out = np.frombuffer(raw, np.int64, n, 8).tolist(), 8 + 8 * n, []
    for size in sizes:
        out.append(raw[at : at + size])
        at += size
    return out


def _pack_run(rows: np.ndarray, room: np.ndarray, refs: np.ndarray, twice: np.ndarray) -> bytes:
    common = _common(rows)
    tails = rows[np.arange(rows.shape[1]) >= common[:, None]]
    return _pack(common.astype(np.uint16), tails, room, refs[~twice], twice.astype(np.uint8))


def _pack_found(refs: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> bytes:
    start = refs["at"] - high
    return _pack(refs["row"].copy(), start, refs["at"] - low + length)


def merge(runs: list[tuple[np.ndarray, bytes]], width: int) -> tuple[list[bytes], list[int], list[int]]:
    """Merge front-coded runs: the strings in order, each one's run, and its common prefix with the one before.

    Each inner place of the tree keeps a loser and its common prefix with the last winner.
    A longer common prefix with the last winner means smaller; only equal ones are compared,
    from there on.
    """
    ways = 1
    while ways < len(runs):
        ways *= 2
    commons = [c.tolist() for c, _ in runs] + [[]] * (ways - len(runs))
    tails = [t for _, t in runs] + [b""] * (ways - len(runs))
    place, offset = [0] * ways, [0] * ways
    heads: list[bytes] = [b""] * ways

    def advance(r: int) -> int:
        """Read the run's next string; its common prefix with the one before, or -1 at the end."""
        i = place[r]
        if i == len(commons[r]):
            return -1
        place[r] = i + 1
        known = commons[r][i]
        stop = offset[r] + width - known
        heads[r] = heads[r][:known] + tails[r][offset[r] : stop]
        offset[r] = stop
        return known

    loser, prefix = [0] * ways, [-1] * ways

    def compare(a: int, b: int, known: int) -> tuple[bool, int]:
        """Whether a's string is not after b's, and their common prefix."""
        x, y = heads[a], heads[b]
        if x == y:
            return True, width
        step = 16
        while x[known : known + step] == y[known : known + step]:
            known += step
        while x[known] == y[known]:
            known += 1
        return x[known] < y[known], known

    def build(node: int) -> tuple[int, int]:
        if node >= ways:
            return node - ways, advance(node - ways)
        (a, p), (b, q) = build(2 * node), build(2 * node + 1)
        return settle(node, a, p, b, q)

    def settle(node: int, a: int, p: int, b: int, q: int) -> tuple[int, int]:
        if p == q and p >= 0:
            first, both = compare(a, b, p)
            if first:
                loser[node], prefix[node] = b, both
                return a, p
            loser[node], prefix[node] = a, both
            return b, q
        if p >= q:
            loser[node], prefix[node] = b, q
            return a, p
        loser[node], prefix[node] = a, p
        return b, q

    strings, owners, common = [], [], []
    winner, known = build(1) if ways > 1 else (0, advance(0))
    while known >= 0:
        strings.append(heads[winner])
        owners.append(winner)
        common.append(known)
        known = advance(winner)
        node = (winner + ways) >> 1
        while node:
            q = prefix[node]
            if q > known:
                loser[node], prefix[node], winner, known = winner, known, loser[node], q
            elif q == known and q >= 0:
                first, both = compare(winner, loser[node], q)
                if first:
                    prefix[node] = both
                else:
                    loser[node], prefix[node], winner = winner, both, loser[node]
            node >>= 1
    return strings, owners, common


def covered(packed: list[bytes], length: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Reference, least and most repeated shift of each context of a range's runs that has any."""
    runs, rooms, refs, twice = [], [], [], []
    for blob in packed:
        common, tails, room, ref, double = _unpack(blob)
        runs.append((np.frombuffer(common, np.uint16), tails))
        rooms.append(np.frombuffer(room, np.uint16).reshape(-1, 2))
        double = np.frombuffer(double, np.uint8).astype(bool)
        full = np.zeros(len(double), REF)
        full[~double] = np.frombuffer(ref, REF)
        refs.append(full)
        twice.append(double)
    strings, owners, common = merge(runs, length + span)
    size = len(strings)
    owner = np.array(owners)
    first = np.cumsum([0] + [len(c) for c, _ in runs])[:-1]
    # a run's strings leave the tree in the run's order
    place = np.empty(size, np.int64)
    for r, at in enumerate(first.tolist()):
        mine = np.flatnonzero(owner == r)
        place[mine] = at + np.arange(len(mine))
    room, ref, double = np.concatenate(rooms)[place], np.concatenate(refs)[place], np.concatenate(twice)[place]
    rows = np.frombuffer(b"".join(strings), np.uint8).reshape(size, length + span)
    right = np.minimum(np.array(common), length)
    least_shift, most_shift = _shifts_within(room, length, span)
    order = _sorted(rows[:, length:]) if span else np.arange(size)
    back = np.empty(size, np.int64)
    back[order] = np.arange(size)
    left = _common(rows[order, length:]) if span else np.zeros(size, np.int64)
    low, high = np.full(size, span + 1), np.full(size, -1)
    for shift in range(span + 1):
        whole = np.flatnonzero((least_shift <= shift) & (shift <= most_shift))
        if not len(whole):
            continue
        kind = np.cumsum(right < length - shift)[whole] * (size + 1) + np.cumsum(left < shift)[back][whole]
        _, which, count = np.unique(kind, return_inverse=True, return_counts=True)
        count += np.bincount(which, double[whole], len(count)).astype(count.dtype)
        again = whole[count[which] > 1]
        low[again] = np.minimum(low[again], shift)
        high[again] = shift
    some = (high >= 0) & ~double
    return ref[some], low[some], high[some]


REF = np.dtype([("row", "S24"), ("at", np.int64)])


def _key(doc_id: int | None, mark: int) -> bytes:
    """A row's key as 24 bytes: presence and id, digest of the text. The first byte is never zero padding at the end."""
    return (doc_id or 0).to_bytes(8, "big", signed=True) + mark.to_bytes(8, "big", signed=True) + (b"\x01" if doc_id is None else b"\x02") + b"\x00" * 6 + b"\x01"


def _unkey(raw: bytes) -> tuple[int | None, int]:
    return (None if raw[16] == 1 else int.from_bytes(raw[:8], "big", signed=True)), int.from_bytes(raw[8:16], "big", signed=True)


def _stepped(own: np.ndarray, place: np.ndarray, hashes: np.ndarray, steps: range | list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, place and hash of the contexts at each step before the anchors, each place of a row once, in slices."""
    order = np.lexsort((place, own))
    own, place, hashes = own[order], place[order], hashes[order]
    shift, last = np.int64(1) << np.int64(40), np.zeros(0, np.int64)
    for i in range(0, len(own), ANCHORS_AT_ONCE):
        part = slice(i, i + ANCHORS_AT_ONCE)
        at = np.concatenate([place[part] - step for step in steps])
        key = np.concatenate([own[part]] * len(steps)) * shift + at
        key, first = np.unique(key[at >= 0], return_index=True)
        which = (np.flatnonzero(at >= 0)[first]) % len(own[part])
        fresh = ~np.isin(key, last)  # steps from two anchors can meet, in the slice before too
        key, which = key[fresh], which[fresh]
        if i + ANCHORS_AT_ONCE < len(own):
            least = own[i + ANCHORS_AT_ONCE] * shift + place[i + ANCHORS_AT_ONCE] - max(steps)
            last = np.concatenate([last[last >= least], key[key >= least]])
        for j in range(0, len(key), 4_000):
            yield key[j : j + 4_000] // shift, key[j : j + 4_000] % shift, hashes[part][which[j : j + 4_000]]


FOUND = "doc_id long, mark long, start long, stop long"


def _found(rows: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    keys = [_unkey(r) for r in rows.tolist()]
    columns = [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(start.astype(np.int64)), pa.array(stop.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "start", "stop"])


def repeated(docs: DataFrame, length: int = 200, hot: int = HOT, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Covered stretches ``(doc_id, mark, start, stop)`` of ``docs(doc_id, text, mark)``; they may overlap."""
    core = core_length(length)
    wide, narrow = length - core, min(HOT_SPAN, length - core)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, place, h = text_anchors(batch.column(2), length)
            names = ["doc_id", "mark", "place", "h"]
            columns = [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(place), pa.array(h.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    placed = docs.select("doc_id", "mark", "text").mapInArrow(find, "doc_id long, mark long, place long, h long")
    # written out, so that the join's sides are plain exchanges, of which large partitions can be split
    counts = cut_lineage(placed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h", (F.col("n") > hot).alias("is_hot")))
    chosen = placed.join(counts, "h").select("doc_id", "mark", F.struct("place", "h", "is_hot").alias("anchor"))
    chosen = chosen.groupBy("doc_id", "mark").agg(F.collect_set("anchor").alias("anchors"))
    chosen = chosen.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "anchors")
    texts = docs.select("doc_id", "mark", "text")
    held = texts.join(chosen, texts["doc_id"].eqNullSafe(chosen["d"]) & (texts["mark"] == chosen["m"])).select("doc_id", "mark", "text", "anchors")
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    ranges = int(max(16, total // range_bytes))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        usual = Contexts(length, wide, ranges, 0)
        often = Contexts(length, narrow, ranges, ranges)
        turn = 0

        def send(contexts: Contexts) -> pa.RecordBatch | None:
            nonlocal turn
            if not contexts.size:
                return None
            out = list(contexts.run())
            turn += 1
            # what is settled here goes anywhere
            where = [r if r >= 0 else -1 - (turn * 7919 + int(xxhash.xxh32_intdigest(b))) % ranges for r, b in out]
            return pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array([b for _, b in out], pa.binary())], names=["target", "run"])

        for batch in batches:
            data, offsets = _binary(batch.column(2))
            lists = batch.column(3)
            size = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            owner = np.repeat(np.arange(batch.num_rows), size)
            if not len(owner):
                continue
            place, h, is_hot = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            keys = np.array([_key(d, m) for d, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], "S24")
            core_hash = h.view(np.uint64)
            for contexts, mine, steps in ((usual, ~is_hot, [0]), (often, is_hot, range(0, wide + 1, narrow + 1))):
                for own, at, hashes in _stepped(owner[mine], place[mine], core_hash[mine], steps):
                    refs = np.zeros(len(own), REF)
                    refs["row"], refs["at"] = keys[own], at
                    contexts.add(data, offsets[own], offsets[own + 1], offsets[own] + at, hashes if contexts is usual else None, refs)
                    if contexts.size >= RUN_BYTES:
                        yield send(contexts)
        for contexts in (usual, often):
            if (last := send(contexts)) is not None:
                yield last

    sent = held.mapInArrow(sort, "target int, run binary").repartition("target").sortWithinPartitions("target")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, runs = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if runs:
                span = wide if now < ranges else narrow
                ref, low, high = covered(runs, length, span)
                if len(ref):
                    yield _found(ref["row"], ref["at"] - high, ref["at"] - low + length)

        for batch in batches:
            for target, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if target < 0:
                    rows, start, stop = _unpack(blob)
                    yield _found(np.frombuffer(rows, "S24"), np.frombuffer(start, np.int64), np.frombuffer(stop, np.int64))
                    continue
                if target != now:
                    yield from close()
                    now, runs = target, []
                runs.append(blob)
        yield from close()

    return sent.mapInArrow(settle, FOUND)


def unite(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def remove(docs: DataFrame, length: int = 200, hot: int = HOT, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(doc_id, kept, n_bytes, n_removed, n_spans, spans)`` per row; ``kept`` holds the remaining bytes."""
    marked = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.coalesce("text", F.lit("")).alias("text"))
    found = repeated(marked, length, hot, range_bytes).groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start", "stop")).alias("found"))
    found = found.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "found")
    texts = marked.select("doc_id", "mark", "text")
    whole = texts.join(found, texts["doc_id"].eqNullSafe(found["d"]) & (texts["mark"] == found["m"]), "left").select("doc_id", "text", "found")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = text.as_py().encode("utf-8")
                parts, at = [], 0
                joined = unite([(s["start"], s["stop"]) for s in spans or ()])
                for a, b in joined:
                    parts.append(raw[at:a])
                    at = b
                parts.append(raw[at:])
                kept = b"".join(parts)
                for column, value in zip(out, (kept, len(raw), len(raw) - len(kept), len(joined), [{"start": a, "stop": b} for a, b in joined]), strict=True):
                    column.append(value)
            span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            columns = [pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.int64(), pa.int64(), pa.int64(), span), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "spans"])

    schema = "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,stop:long>>"
    return whole.mapInArrow(cut, schema)
