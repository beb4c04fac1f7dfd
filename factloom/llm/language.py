"""Word-first language identification with back-off to shorter character n-grams.

A model holds, per language, log relative frequencies of its words and of character
n-grams (orders ``max_order`` down to 1, words padded with a boundary sign). A word that
the model knows in any language is scored by its word frequencies. An unseen word is read
from its start to its end: at each place the longest known n-gram is scored and stepped
over, and a place without any known n-gram costs the floor; the word's score is the mean.
A text's language is the one with the highest sum over all its words.

The score is the softmax of these sums for ``EVIDENCE * n / (EVIDENCE + n)`` words in place
of n, as the words of a text aren't independent: one law for texts of any length.

The model is fitted on at most about ``fit_rows`` distinct labelled texts, chosen by a hash
of the text, so that equal tables give equal models. It keeps every word and n-gram that
occurs at least twice (``min_count``) in them, whatever the table's size. Every row is
predicted on its whole text, every word on all its letters.

Edge cases: null texts and texts without letters are ``und`` with score 0; ties go to the
first language in code point order; without any labelled row all rows are ``und``; rows
with a null ``lang`` are predicted but not learned from; repeated rows are fitted once and
predicted alike; very long texts and words take time and memory in proportion; an empty
table gives an empty result; other columns pass through, and columns named as the results
are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.runtime import cut_lineage

WORD = re.compile(r"[^\W\d_]+")
#: The same words for the JVM.
SQL_WORD = r"\p{L}+"
EDGE = "\x01"
UNKNOWN = "und"
#: An unseen word counts this much of a known one.
GRAM_WEIGHT = 0.5
#: The number of independent words that a text's evidence tends to.
EVIDENCE = 50
#: Unseen words are remembered within a task up to this length, and up to so many of them.
CACHED_LETTERS, CACHED_WORDS = 64, 100_000


@dataclass(frozen=True)
class LanguageModel:
    """Scores by language position; ``words`` and ``grams`` map an entry to one value per language."""

    langs: tuple[str, ...]
    words: dict[str, tuple[float, ...]]
    grams: dict[str, tuple[float, ...]]
    max_order: int
    floor: float

    def unseen(self, word: str) -> tuple[float, ...]:
        """Mean score of the longest known n-grams of a word, per language."""
        padded, at, used = f"{EDGE}{word}{EDGE}", 0, 0
        total = [0.0] * len(self.langs)
        while at < len(padded):
            for order in range(min(self.max_order, len(padded) - at), 0, -1):
                found = self.grams.get(padded[at : at + order])
                if found is not None:
                    break
            else:
                order, found = 1, (self.floor,) * len(self.langs)
            total = [a + b for a, b in zip(total, found, strict=True)]
            used, at = used + 1, at + max(1, order - 1)
        return tuple(GRAM_WEIGHT * x / used for x in total)

    def predict(self, text: str | None, cache: dict[str, tuple[float, ...]]) -> tuple[str, float]:
        counts = Counter(WORD.findall(text.lower())) if text else None
        # the pattern also takes signs such as superscripts, which are no letters
        if not counts or not self.langs or not any(c.isalpha() for word in counts for c in word):
            return UNKNOWN, 0.0
        size = len(self.langs)
        total, seen = [0.0] * size, 0
        for word, n in counts.items():
            scores = self.words.get(word) or cache.get(word)
            if scores is None:
                scores = self.unseen(word)
                if len(word) <= CACHED_LETTERS:
                    if len(cache) >= CACHED_WORDS:
                        cache.clear()
                    cache[word] = scores
            for i in range(size):
                total[i] += n * scores[i]
            seen += n
        best = max(range(size), key=lambda i: (total[i], -i))
        scale = EVIDENCE / (EVIDENCE + seen)
        return self.langs[best], 1 / sum(math.exp(max(-700.0, scale * (x - total[best]))) for x in total)


def _tables(counts: dict[str, Counter], langs: tuple[str, ...], floor: float) -> dict[str, tuple[float, ...]]:
    sums = {lang: max(1, sum(counts[lang].values())) for lang in langs}
    keys = sorted(set().union(*(counts[lang] for lang in langs))) if langs else []
    return {k: tuple(math.log(counts[lang][k] / sums[lang]) if counts[lang][k] else floor for lang in langs) for k in keys}


def _grams(word: Column, max_order: int) -> Column:
    """All n-grams of the padded word, repeats included; lengths count code points."""
    padded = F.concat(F.lit(EDGE), word, F.lit(EDGE))

    def of(size: int) -> Column:
        places = F.sequence(F.lit(1), F.length(padded) - size + 1)
        return F.when(F.length(padded) >= size, F.transform(places, lambda i: F.substring(padded, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.array(*[of(n) for n in range(1, max_order + 1)]))


def fit(labelled: DataFrame, fit_rows: int = 20_000, min_count: int = 2, max_order: int = 4, floor: float = -16.0) -> LanguageModel:
    """Fit on ``labelled(text, lang)``; counts are aggregated by Spark, only what ``fit_rows`` texts repeat reaches the driver."""
    rows = labelled.select("text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    total = rows.count()
    if total > fit_rows:  # a hash threshold, not a sort: about fit_rows rows whatever the table's size
        share = int(fit_rows / total * (1 << 30))
        rows = rows.where(F.shiftrightunsigned(F.xxhash64("text", "lang"), 34) < share)
    rows = rows.dropDuplicates()  # copies share a hash, so a large group of them is one row
    words = (
        rows.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(SQL_WORD), F.lit(0))).alias("entry"))
        .groupBy("lang", "entry")
        .agg(F.count("*").alias("n"))
    )
    words = cut_lineage(words)
    grams = words.select("lang", "n", F.explode(_grams(F.col("entry"), max_order)).alias("entry")).groupBy("lang", "entry").agg(F.sum("n").alias("n"))
    tables = []
    for counted in (words, grams):
        counts: dict[str, Counter] = defaultdict(Counter)
        for lang, entry, n in counted.where(F.col("n") >= min_count).collect():
            counts[lang][entry] = n
        tables.append(counts)
    langs = tuple(sorted({r["lang"] for r in words.select("lang").distinct().collect()}))
    return LanguageModel(langs, *(_tables(counts, langs, floor) for counts in tables), max_order, floor)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` without ``text``, with ``lang_pred`` and ``score``."""
    rest = [c for c in docs.columns if c not in ("text", "lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by what fit_rows texts repeat

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[float, ...]] = {}
        model = shared.value
        for batch in batches:
            found = [model.predict(t.as_py(), cache) for t in batch.column("text")]
            columns = [batch.column(c) for c in rest]
            columns += [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*rest, "lang_pred", "score"])

    slim = docs.select(*rest, "text")
    return slim.mapInArrow(run, slim.drop("text").schema.add("lang_pred", "string").add("score", "double"))


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the rows that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def keep(docs: DataFrame, model: LanguageModel, min_score: float = 0.3) -> DataFrame:
    """The rows of ``docs``, whole, whose language the model can tell with at least ``min_score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[float, ...]] = {}
        model = shared.value
        for batch in batches:
            found = (model.predict(t.as_py(), cache) for t in batch.column("text"))
            yield batch.filter(pa.array([lang != UNKNOWN and score >= min_score for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
