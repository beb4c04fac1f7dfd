"""The pipeline against a plain version of each stage, on a small table."""

from __future__ import annotations

import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import language, mixing, shingles, similar, simhash

from .test_native import brute_leaks

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed):
    rng = random.Random(seed)
    stock = {"en": ["the", "house", "with", "river", "and"], "fr": ["la", "maison", "avec", "rivière", "et"]}
    vocabulary = {k: v * 3 + [f"{v[i % 5]}{i}{k}" .replace("0", "o").replace("1", "i") for i in range(150)] for k, v in stock.items()}
    prose = lambda lang, n: " ".join(rng.choice(vocabulary[lang]) for _ in range(n))
    items = [(i, prose("en", 30)) for i in range(3)]
    rows = []
    for i in range(120):
        lang = rng.choice(["en", "fr"])
        text = prose(lang, rng.randint(60, 90))
        kind = rng.randrange(6)
        if rows and kind == 0:
            text = rng.choice(rows)[1]
        elif rows and kind == 1:
            words = rng.choice(rows)[1].split()
            words[rng.randrange(3)] = "changed"
            text = " ".join(words)
        elif kind == 2:
            text = f"{text} {rng.choice(items)[1]}"
        rows.append((i, text, lang, f"s{rng.randrange(3)}", len(text)))
    rows += [(900, None, "en", "s0", None), (901, "123 456", "en", None, 7), (902, "", "en", "s1", 0), rows[5], rows[5]]
    return rows, items


def grams(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    rows, items = corpus(5)
    folder = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def test_every_stage(spark, staged):
    folder, rows, items = staged
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = language.fit(docs)
    kept = [r for r in rows if (p := model.predict(r[1], {}))[0] != "und" and p[1] >= 0.3]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_dedup", "decontamination", "mixing", "sharding"]

    def step(name, frame):
        out = stages[name](spark, frame, folder).checkpoint()
        return out, [tuple(r[c] for c in COLUMNS) for r in out.collect()]

    docs, found = step("language_id", docs)
    assert Counter(found) == Counter(kept) and {900, 901, 902}.isdisjoint(r[0] for r in found)

    distinct = {r[0]: r[1] for r in sorted(kept, reverse=True)}
    first = {}
    for i, text in sorted(distinct.items()):
        first.setdefault(text, i)
    ids = sorted(first.values())
    root = {i: i for i in ids}
    for a in ids:
        for b in ids:
            x, y = grams(distinct[a]), grams(distinct[b])
            if a < b and len(x & y) >= 0.8 * len(x | y):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    expected = {i for i in ids if root[i] == i}
    docs, found = step("near_dedup", docs)
    assert {r[0] for r in found} == expected and len(found) == len(expected) < len(ids)

    leaked = {d for d, _ in brute_leaks([(r[0], r[1]) for r in found], items)}
    before = found
    docs, found = step("decontamination", docs)
    assert Counter(found) == Counter(r for r in before if r[0] not in leaked) and leaked

    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    taken = {r[0]: r[4] // r[1] for r in con.execute(mixing.ORACLE_SQL).fetchall() if r[1]}
    before = found
    docs, found = step("mixing", docs)
    assert Counter(found) == Counter({r: taken[r[0]] for r in before if taken[r[0]]})

    out = stages["sharding"](spark, docs, folder)
    rows = out.collect()
    assert out.columns == [*COLUMNS, "shard", "slot"] and Counter(tuple(r[c] for c in COLUMNS) for r in rows) == Counter(found)
    slots = [sorted(r["slot"] for r in rows if r["shard"] == k) for k in range(corpus_pipeline.SHARDS)]
    assert all(s == list(range(len(s))) for s in slots) and max(map(len, slots)) - min(map(len, slots)) <= 1


def test_near_dedup_with_clashing_columns_and_null_ids(spark):
    rows = [(None, "a b c d e f", "x"), (None, "a b c d e f", "x"), (3, "A b c d e f", "x"), (None, "other", "x"), (5, None, "x"), (6, None, "x"), (7, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, d string").withColumns({n: F.lit(n) for n in ("m", "mark", "fp", "first")})
    found = simhash.keep_one(docs)
    assert found.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in found.collect()) == Counter([(3, "A b c d e f"), (None, "other"), (5, None)])


def test_run(spark, staged):
    folder, rows, _ = staged
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == [*COLUMNS, "shard", "slot"] and 0 < out.select("doc_id").distinct().count() < len(rows)


def test_run_on_an_empty_table(spark, staged, tmp_path):
    folder = staged[0]
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def closure(texts, similarity=0.8):
    """The least position of each text's class, by all pairs."""
    sets = [grams(t) for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return root


def kept_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return sorted(r["doc_id"] for r in simhash.keep_one(docs).collect())


def test_near_dedup_compares_texts_of_equal_fingerprints(spark):
    rng = random.Random(2)
    line = " ".join(f"line{i}" for i in range(11))
    own = [[f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(6)]
    texts = [" ".join([line] * 40 + words) for words in own]
    texts += [" ".join([line] * 40 + words[:-1] + ["edited"]) for words in own]
    assert len({simhash.text_fingerprint(t, 5) for t in texts}) == 1
    assert kept_of(spark, texts) == sorted(set(closure(texts))) == list(range(6))


def near_copies(seed, groups=6, size=25):
    """Texts in groups of edits of one original, from light to heavy, and edits of edits."""
    rng = random.Random(seed)
    texts = []
    for g in range(groups):
        original = [f"w{g}x{rng.randrange(10**6)}" for _ in range(rng.randint(40, 120))]
        last = original
        for _ in range(size):
            words = list(rng.choice([original, last]))
            for _ in range(rng.randint(0, len(words) // 40 + 1)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            last = words
            texts.append(" ".join(words))
    rng.shuffle(texts)
    return list(dict.fromkeys(texts))


@pytest.mark.parametrize(("hot", "ids", "rows"), [(4_000, 500_000, 20_000), (6, 0, 10)])
def test_near_dedup_finds_every_class_whatever_its_limits_are(spark, monkeypatch, hot, ids, rows):
    """Against all pairs; with small limits large buckets are cut, ids are joined by shuffle and tables hold few rows."""
    texts = near_copies(3)
    monkeypatch.setattr(similar, "BROADCAST_IDS", ids)
    monkeypatch.setattr(similar, "ROWS_AT_ONCE", rows)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    every, members, held = similar.distinct_texts(docs, 5)
    found = {r["node"]: r["component"] for r in similar.classes(members, held, hot_bucket=hot).collect()}
    doc = {r["id"]: r["first"]["doc_id"] for r in every.collect()}
    by_class = {}
    for i, d in doc.items():
        by_class.setdefault(found.get(i, i), set()).add(d)
    expected = {}
    for d, root in enumerate(closure(texts)):
        expected.setdefault(root, set()).add(d)
    assert sorted(map(sorted, by_class.values())) == sorted(map(sorted, expected.values()))
    assert max(map(len, expected.values())) > 10


def test_share_of_similar_pairs_that_become_candidates():
    """By similarity, of pairs of texts: those that share a band and lie within the radius."""
    rng = random.Random(5)
    seen = {0.8: [0, 0], 0.85: [0, 0], 0.9: [0, 0]}
    for _ in range(1500):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(30, 200))]
        edited = list(words)
        for _ in range(rng.randint(1, max(1, len(words) // 40))):
            edited[rng.randrange(len(edited))] = f"x{rng.randrange(10**6)}"
        a, b = (np.unique(shingles.shingle_hashes(" ".join(x), 5)) for x in (words, edited))
        shared = len(np.intersect1d(a, b))
        likeness = shared / (len(a) + len(b) - shared)
        band = max((x for x in seen if x <= likeness), default=None)
        if band is not None:
            met = set(similar.bands(a)) & set(similar.bands(b)) and (shingles.majority_bits(a) ^ shingles.majority_bits(b)).bit_count() <= similar.RADIUS
            seen[band][0] += bool(met)
            seen[band][1] += 1
    assert all(n > 100 and found >= 0.99 * n for found, n in seen.values())


def test_near_dedup_of_very_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(400_000))
    texts = [long, long + " end", "x " * 1_000_000, " " * 3_000_000, None, "y" * 3_000_000]
    assert kept_of(spark, texts) == [0, 2, 3, 5]
