"""Personal data by offset-preserving deobfuscation.

Base identifiers are found in the text as it is. Transducers then rewrite it step by step:
look-alike letters, compatibility forms and digits of other scripts become ASCII, invisible
characters go, spelled digits (English, German, French, Spanish) become digits, bracketed and
bare words for the at sign and the dot become signs. Each step keeps for every stretch where
it came from; identifiers that show only in the rewritten text are mapped back to code point
spans of the source and added.

A span is added if the rewriting changed it and it either meets no base span or holds whole
ones and more. A bare word for the at sign counts only where the host's dot was disguised too,
so that plain prose stays.

Edge cases: a null or empty text has no spans (and the digest of an empty string); very long
texts, and long runs of one character class, cost linear time; of spans that start together
the kinds go in their fixed order; repeated rows are treated alike; an empty table gives an
empty result; null ids and other columns pass through, columns named as the results are
replaced.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")

# Letters and signs that look like ASCII ones and have no compatibility form.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ѵ": "v", "ь": "b", "к": "k", "м": "m", "т": "t", "п": "n",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y", "Ԍ": "G",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "υ": "u", "γ": "y", "τ": "t",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "զ": "q", "ա": "w",
    "ı": "i", "ȷ": "j", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʏ": "y", "ɢ": "g", "ɪ": "i", "ɴ": "n", "ʀ": "r", "ʙ": "b", "ʜ": "h", "ʟ": "l",
    "ᴀ": "a", "ᴄ": "c", "ᴅ": "d", "ᴇ": "e", "ᴊ": "j", "ᴋ": "k", "ᴍ": "m", "ᴏ": "o", "ᴘ": "p", "ᴛ": "t", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z",
    "。": ".", "‐": "-", "−": "-", "–": "-", "‒": "-", "⁃": "-",
}
# Characters that don't show.
INVISIBLE = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufeff"
# Blocks whose characters may have an ASCII compatibility form.
COMPATIBLE = "\u2010\u2011\u2024\u2070-\u209c\u2100-\u214f\u2460-\u249b\u24b6-\u24ea\ufe50-\ufe6b\uff01-\uff5e\U0001d400-\U0001d7ff\U0001f100-\U0001f10a\U0001f130-\U0001f149"
# Spelled digits, and words for signs.
DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
DOT_WORDS = "dot|punkt|punto|point"
AT_WORDS = "at|arroba|arobase|arobas|klammeraffe"
PLUS_WORDS = "plus|más|mas"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can't begin inside a run of digits: the run's first digit would have matched
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

_WORD_DIGIT = "(?:" + "|".join(sorted(DIGITS, key=len, reverse=True)) + ")"
_ODD_CHARACTER = re.compile("[" + "".join(HOMOGLYPHS) + INVISIBLE + COMPATIBLE + r"]|(?![0-9])\d")
_SPELLED = re.compile(rf"(?i)(?<![^\W_])(?:(?:{PLUS_WORDS})[ -]+)?{_WORD_DIGIT}(?:[ -]+(?:{_WORD_DIGIT}|{DOT_WORDS}|[0-9]+)){{3,}}(?![^\W_])")
_INNER = rf"(?:{AT_WORDS}|@|{DOT_WORDS}|\.)"
# blanks on the left are taken by hand: a pattern that begins with them would be tried at each blank of a run
_BRACKETED = re.compile(rf"(?i)(?:\[[ \t]*{_INNER}[ \t]*\]|\([ \t]*{_INNER}[ \t]*\)|\{{[ \t]*{_INNER}[ \t]*\}}|<[ \t]*(?:{AT_WORDS}|{DOT_WORDS})[ \t]*>)[ \t]*")
_HOST = rf"[A-Za-z0-9-]+(?:(?:[ \t]+(?:{DOT_WORDS})[ \t]+|\.)[A-Za-z0-9-]+)+"
_BARE = re.compile(rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(?:[ \t]+(?:{AT_WORDS})[ \t]+|@)({_HOST})")
_DOTTED_NUMBERS = re.compile(rf"(?i)(?<![0-9.])[0-9]{{1,3}}(?:[ \t]+(?:{DOT_WORDS})[ \t]+[0-9]{{1,3}}){{3}}(?![0-9])")
_DOT_WORD = re.compile(rf"(?i)[ \t]+(?:{DOT_WORDS})[ \t]+")
_AT_WORD = re.compile(rf"(?i)[ \t]+(?:{AT_WORDS})[ \t]+")
_HAS_SIGN_WORD = re.compile(rf"(?i)[ \t](?:{DOT_WORDS}|{AT_WORDS})[ \t]")
_SPELLED_PART = re.compile(rf"(?i)(?:{PLUS_WORDS})[ -]+|{_WORD_DIGIT}(?![^\W_])|[ -]+(?:{DOT_WORDS})[ -]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches, found from each at sign: the local part is the run of characters before it."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _EMAIL.match(text, start) if start < at else None
        if found:
            yield "email", start, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[Span]:
    """The plain identifiers, by start and then kind."""
    out = list(_emails(text))
    for m in _IP.finditer(text) if "." in text else ():
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


class Rewritten:
    """A text with the source position of each of its stretches."""

    def __init__(self, source: str):
        self.text, self.new, self.old, self.size = source, [0], [0], [len(source)]

    def source(self, at: int, end: bool) -> int:
        """Source position of a boundary of the text; ``end`` takes the far side of a replaced stretch."""
        if end:
            k = bisect_right(self.new, at - 1) - 1
            inside = at - self.new[k]
            length = (self.new[k + 1] if k + 1 < len(self.new) else len(self.text)) - self.new[k]
            return self.old[k] + (self.size[k] if length != self.size[k] else inside)
        k = bisect_right(self.new, at) - 1
        length = (self.new[k + 1] if k + 1 < len(self.new) else len(self.text)) - self.new[k]
        return self.old[k] + (0 if length != self.size[k] else at - self.new[k])

    def replaced(self, at: int) -> bool:
        """Whether the character at a place of the text stands for something else."""
        k = bisect_right(self.new, at) - 1
        length = (self.new[k + 1] if k + 1 < len(self.new) else len(self.text)) - self.new[k]
        return length != self.size[k]

    def replace(self, edits: list[tuple[int, int, str]]) -> Rewritten:
        """Apply ``(start, end, text)`` edits of the present text, in order and apart."""
        pieces: list[tuple[str, int, int]] = []

        def keep(a: int, b: int) -> None:
            k = bisect_right(self.new, a) - 1
            while a < b:
                stop = min(b, self.new[k + 1] if k + 1 < len(self.new) else len(self.text))
                if stop > a:
                    pieces.append((self.text[a:stop], start := self.source(a, False), self.source(stop, True) - start))
                a, k = stop, k + 1

        at = 0
        for start, end, text in edits:
            keep(at, start)
            old = self.source(start, False)
            pieces.append((text, old, self.source(end, True) - old))
            at = end
        keep(at, len(self.text))
        out = Rewritten("")
        out.new, out.old, out.size, place, texts = [], [], [], 0, []
        for text, old, size in pieces:
            if text:
                out.new.append(place)
                out.old.append(old)
                out.size.append(size)
                texts.append(text)
                place += len(text)
        out.text = "".join(texts)
        if not texts:
            out.new, out.old, out.size = [0], [0], [0]
        return out


def _plain_character(c: str) -> str:
    """What stands for a character in the rewritten text; itself if nothing does."""
    if c in INVISIBLE:
        return ""
    if c in HOMOGLYPHS:
        return HOMOGLYPHS[c]
    plain = unicodedata.normalize("NFKC", c)
    if len(plain) == 1 and plain.isascii():
        return plain
    digit = unicodedata.digit(c, None)
    return c if digit is None else str(digit)


def _sign(disguise: str) -> str:
    return "@" if _INNER_AT.search(disguise) else "."


_INNER_AT = re.compile(rf"(?i){AT_WORDS}|@")


def _characters(now: Rewritten) -> list[tuple[int, int, str]]:
    found = ((m.start(), m.end(), m[0], _plain_character(m[0])) for m in _ODD_CHARACTER.finditer(now.text))
    return [(a, b, plain) for a, b, odd, plain in found if plain != odd]


def _spelled(now: Rewritten) -> list[tuple[int, int, str]]:
    def plain(part: str) -> str:
        word = part.strip(" -").lower()
        return "+" if word in PLUS_WORDS.split("|") else DIGITS.get(word, ".")

    return [(m.start() + p.start(), m.start() + p.end(), plain(p[0])) for m in _SPELLED.finditer(now.text) for p in _SPELLED_PART.finditer(m[0])]


def _bracketed(now: Rewritten) -> list[tuple[int, int, str]]:
    edits, free = [], 0
    for m in _BRACKETED.finditer(now.text):
        start = m.start()
        while start > free and now.text[start - 1] in " \t":
            start -= 1
        edits.append((start, m.end(), _sign(m[0])))
        free = m.end()
    return edits


def _numbers(now: Rewritten) -> list[tuple[int, int, str]]:
    return [(m.start() + p.start(), m.start() + p.end(), ".") for m in _DOTTED_NUMBERS.finditer(now.text) for p in _DOT_WORD.finditer(m[0])]


def _bare(now: Rewritten) -> list[tuple[int, int, str]]:
    """``name at host dot tld``; a dot in disguise is asked for, so that plain prose stays."""
    edits = []
    for m in _BARE.finditer(now.text):
        host = m.start(1)
        parts = [(host + p.start(), host + p.end(), ".") for p in _DOT_WORD.finditer(m[1])]
        if parts or any(now.replaced(i) for i in range(host, m.end()) if now.text[i] == "."):
            at = _AT_WORD.search(now.text, m.start(), host)
            edits += ([(at.start(), at.end(), "@")] if at else []) + parts
    return edits


def deobfuscate(text: str) -> Rewritten | None:
    """The rewritten text, or None where nothing is disguised."""
    now = Rewritten(text)
    if not text.isascii() and (odd := _characters(now)):
        now = now.replace(odd)
    steps = [_spelled]
    if any(x in now.text for x in "[({<"):
        steps.append(_bracketed)
    if _HAS_SIGN_WORD.search(now.text):
        steps += [_numbers, _bare]
    for step in steps:
        if edits := step(now):
            now = now.replace(edits)
    return now if len(now.new) > 1 or now.text != text else None


class _Sweep:
    """Spans of one kind, which don't overlap, so that starts and ends both ascend."""

    def __init__(self, spans: list[Span]):
        self.starts, self.ends = [a for _, a, _ in spans], [b for _, _, b in spans]

    def allows(self, a: int, b: int) -> bool:
        """Whether a..b meets none of the spans, or holds those that it meets and more."""
        low, high = bisect_right(self.ends, a), bisect_left(self.starts, b)
        if low >= high:
            return True
        first, last = self.starts[low], self.ends[high - 1]
        return a <= first and last <= b and (high - low > 1 or (a, b) != (first, last))


def all_spans(text: str, base: list[Span]) -> list[Span]:
    """Base spans and those that only the rewritten text shows, by start and then kind."""
    plain = deobfuscate(text)
    if plain is None:
        return base
    out = list(base)
    sweeps = [_Sweep([s for s in base if s[0] == kind]) for kind in KINDS]
    for kind, start, end in base_spans(plain.text):
        a, b = plain.source(start, False), plain.source(end, True)
        if text[a:b] != plain.text[start:end] and all(s.allows(a, b) for s in sweeps):
            out.append((kind, a, b))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame) -> DataFrame:
    """``docs`` without ``text``, with the base counts and digest and all spans of each row's whole text."""
    names = [f"n_{k}" for k in KINDS] + ["base_sha256", "spans"]
    rest = [c for c in docs.columns if c != "text" and c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column("text"):
                text = value.as_py() or ""
                base = base_spans(text)
                kinds = [k for k, _, _ in base]
                rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(all_spans(text, base))))
            found = list(zip(*rows, strict=True)) or [()] * len(names)
            columns = [pa.array(x, pa.int64() if i < len(KINDS) else pa.string()) for i, x in enumerate(found)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + columns, names=rest + names)

    slim = docs.select(*rest, "text")
    schema = slim.drop("text").schema
    for i, name in enumerate(names):
        schema = schema.add(name, "long" if i < len(KINDS) else "string")
    return slim.mapInArrow(run, schema)


def redact(text: str | None, mark: str = "<{}>") -> str | None:
    """The text with every span replaced by its kind; overlapping spans become one."""
    if text is None:
        return None
    out, at = [], 0
    for kind, start, end in all_spans(text, base_spans(text)):
        if start >= at:
            out += [text[at:start], mark.format(kind.upper())]
        at = max(at, end)
    return "".join(out) + text[at:]
