"""The operators that use DataFrame functions alone, against SQL or brute force."""

from __future__ import annotations

import pathlib
import random
import re
import textwrap
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from factloom.llm import chat, decontaminate, licences, mixing, queries, sharding
from factloom.llm.licence_texts import TEMPLATES

SF = "/root/testdata/sf0.01"
TABLES = ("documents", "conversations", "benchmark")
DOCS = "doc_id long, text string, lang string, source string"


def sql_rows(query, **frames):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, frame in frames.items():
        con.register("own", frame)
        con.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM own")
    found = con.execute(query)
    names = [d[0] for d in found.description]
    return Counter(tuple(sorted(zip(names, map(str, r), strict=True))) for r in found.fetchall())


def spark_rows(df):
    return Counter(tuple(sorted((k, str(v)) for k, v in r.asDict().items())) for r in df.collect())


@pytest.mark.parametrize("name", ["op3_decontamination", "op5_chat_formatting", "op8_mixing", "op10_licence_scan"])
def test_queries_match_their_sql(spark, name):
    assert spark_rows(queries.queries()[name](spark, SF)) == sql_rows(queries.oracle_sql()[name])


def test_chat_edges_match_sql(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hé"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 3, None, "x"), (1, 4, "ann", ""), (2, 0, "system", "alone"), (None, 0, "ann", "lost"), (None, 1, "bob", "lost too"), (None, 1, "bob", "lost too"), (None, 0, "system", "x"), (4, 0, "eve", "a<|end|>\n<|assistant|>\nb <\\|x|\\> <|"), (4, 1, "a|>\n<|assistant", "|><|>"), (3, None, "ann", "first"), (3, 1, "bob", "second")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("place", F.lit("clash"))
    found = chat.rotate(turns)
    assert spark_rows(found) == sql_rows(chat.ORACLE_SQL, conversations=turns.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    for row in found.collect():
        spans = [tuple(map(int, s.split(":"))) for s in row["mask"].split(",")]
        own = [row["rendered"][a:b] for a, b in spans]
        assert all(x.endswith(chat.END) for x in own) and sum(map(len, own)) == row["masked_chars"]
        signs = re.findall(r"<\|.*?\|>", row["rendered"], re.S)
        assert len(signs) == 2 * row["n_turns"] and signs[1::2] == ["<|end|>"] * row["n_turns"]
        assert row["rendered"].count(chat.OWN_HEADER) == row["n_own"] == len(own)
    assert chat.rotate(turns.limit(0)).count() == 0


def test_chat_of_very_long_texts(spark):
    turns = spark.createDataFrame([(1, i, "ab"[i % 2], "x" * 3_000_000) for i in range(4)], "conv_id long, turn int, role string, text string")
    found = chat.rotate(turns).collect()
    assert [(r["speaker"], r["n_own"], r["masked_chars"]) for r in found] == [("a", 2, 6_000_016), ("b", 2, 6_000_016)]


def documents(spark, seed, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = None if rng.random() < 0.1 else "big" if rng.random() < 0.4 else f"s{rng.randint(0, 6)}"
        text = None if rng.random() < 0.05 else " ".join("w" * rng.randint(1, 5) for _ in range(rng.choice([0, 1, 5, 30])))
        rows.append((i, text, "en", source))
    return spark.createDataFrame([*rows, rows[0], rows[0]], DOCS)


@pytest.mark.parametrize("seed", [1, 2])
def test_mixing_matches_sql(spark, seed):
    docs = documents(spark, seed).withColumns({n: F.lit("clash") for n in ("size", "s", "rest")})
    found = mixing.mix_sizes(docs).select("doc_id", "size", "source_size", "target", "taken")
    assert spark_rows(found) == sql_rows(mixing.ORACLE_SQL, documents=docs.toPandas())
    whole = mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")
    assert spark_rows(whole) == spark_rows(found)
    rows = found.collect()
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in rows)
    per = mixing.mix_sizes(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("most"))
    assert all(abs(r["taken"] - r["target"]) <= r["most"] for r in per.collect())


def test_mixing_by_shuffle_joins_and_of_very_long_texts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    rows = [(1, "w " * 1_000_000, "en", "a"), (2, "x" * 5_000_000, "en", "a"), (3, " " * 5_000_000, "en", None), (4, "one two", "en", "b")]
    docs = documents(spark, 3).unionByName(spark.createDataFrame(rows, DOCS))
    found = mixing.mix_sizes(docs).select("doc_id", "size", "source_size", "target", "taken")
    assert spark_rows(found) == sql_rows(mixing.ORACLE_SQL, documents=docs.toPandas())


def test_mixing_targets_fill_up(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 10), (None, 50)], "source string, source_size long")
    found = {r["source"]: r["target"] for r in mixing.targets(sizes, (3, 1, 2), 1.5, 2.0).collect()}
    assert found["a"] == 200 and found["c"] == 20 and found[None] == 100
    assert sum(found.values()) == pytest.approx(1.5 * 1160)
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0


def test_shards_hold_every_row_once(spark):
    docs = documents(spark, 5, 997).withColumn("slot", F.lit("clash"))
    found = sharding.shard(docs, 40, bucket_bytes=2000)
    rows = found.collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r["doc_id"], r["text"]) for r in docs.collect())
    slots = {k: sorted(r["slot"] for r in rows if r["shard"] == k) for k in range(40)}
    assert all(s == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["slot"], r["shard"]))]
    moved = sum(a != b for a, b in zip(order, sorted(order), strict=True))
    assert moved > 900
    assert [r["doc_id"] for r in sorted(sharding.shard(docs, 40, bucket_bytes=2000).collect(), key=lambda r: (r["slot"], r["shard"]))] == order
    assert sharding.shard(docs.limit(0), 40).count() == 0


def fisher_yates(size, bucket, hashes):
    left, out = list(range(size)), []
    for last in range(size - 1, -1, -1):
        drawn = hashes[bucket, last] % (last + 1)
        out.append(left[drawn])
        left[drawn] = left[last]
        left.pop()
    return out


def brute_places(spark, docs, shards, seed, bucket_bytes, bucket_rows):
    """(shard, slot) of each row by lists; only the hash function is the engine's."""
    columns = docs.columns
    copies = Counter()
    keyed = []
    for r in docs.select("*", F.xxhash64(*columns).alias("h1"), F.xxhash64(F.lit(1), *columns).alias("h2")).collect():
        keyed.append((r["h1"], r["h2"], copies[tuple(r)], (r["doc_id"], r["text"])))
        copies[tuple(r)] += 1
    total = sum(len((r[3][1] or "").encode()) + 16 for r in keyed)
    n = max(1, -(-total // bucket_bytes), -(-len(keyed) // bucket_rows))
    rows = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(keyed)], "i int, a long, b long, c long")
    dealt = {r["i"]: r["h"] % n for r in rows.select("i", F.xxhash64(F.lit(seed), "a", "b", "c").alias("h")).collect()}
    buckets = [sorted((r for i, r in enumerate(keyed) if dealt[i] == b), key=lambda r: r[:3]) for b in range(n)]
    steps = spark.createDataFrame([(b, i) for b, x in enumerate(buckets) for i in range(len(x))], "b long, i int")
    draws = {(r["b"], r["i"]): r["h"] for r in steps.select("b", "i", F.xxhash64(F.lit(seed), "b", "i").alias("h")).collect()}
    order = [x[k][3] for b, x in enumerate(buckets) for k in fisher_yates(len(x), b, draws)]
    return Counter((row, p % shards, p // shards) for p, row in enumerate(order))


@pytest.mark.parametrize(("partitions", "copies_at_once", "broadcast_rows"), [(3, 100_000, 100_000), (7, 4, 100_000), (2, 7, 1)])
def test_shards_match_a_plain_placement(spark, monkeypatch, partitions, copies_at_once, broadcast_rows):
    """The same places whatever the partitions are, with a third of the rows equal."""
    monkeypatch.setattr(sharding, "COPIES_AT_ONCE", copies_at_once)
    monkeypatch.setattr(sharding, "BROADCAST_ROWS", broadcast_rows)
    monkeypatch.setattr(sharding, "GROUP", 3)
    docs = documents(spark, 6, 200)
    docs = docs.unionByName(spark.createDataFrame([(None, None, None, None)] * 100, DOCS)).repartition(partitions)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = sharding.shard(docs, 7, seed=9, bucket_bytes=1500, bucket_rows=25)
        rows = Counter(((r["doc_id"], r["text"]), r["shard"], r["slot"]) for r in found.collect())
        assert rows == brute_places(spark, docs, 7, 9, 1500, 25)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_sharding_of_a_very_long_text(spark):
    docs = spark.createDataFrame([(i, "x" * (5_000_000 if i == 3 else 5)) for i in range(20)], "doc_id long, text string")
    assert sorted(r["n"] for r in sharding.shard(docs, 4).select(F.length("text").alias("n")).collect()) == [5] * 19 + [5_000_000]


def test_sharding_query(spark, tmp_path):
    found = queries.op4_sharding(spark, SF)
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = found.collect()
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in rows} == {(i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in docs.items()}
    sharding.write_shards(found, f"{tmp_path}/out", rows_per_file=10)
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(docs)


def brute_leaks(docs, items, similarity=0.8):
    def grams(text):
        tokens = re.findall(r"[^\W_]+", (text or "").lower())
        return [tuple(tokens[i : i + 5]) for i in range(len(tokens) - 4)] if len(tokens) >= 5 else [tuple(tokens)] if tokens else []

    out = {}
    for item, text in items:
        wanted = grams(text)
        for doc, body in docs:
            own = grams(body)
            best = 0
            for at in range(max(1, len(own) - len(wanted) + 1)) if wanted and own else ():
                window = own[at : at + len(wanted)]
                shared = sum((Counter(window) & Counter(wanted)).values())
                best = max(best, shared / (len(window) + len(wanted) - shared))
            if best >= similarity:
                out[doc, item] = round(best, 6)
    return out


def leaky(seed):
    rng = random.Random(seed)
    vocabulary = [f"wörd{i}" for i in range(400)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(words(rng.randint(11, 60)))) for i in range(12)]
    items += [(90, None), (91, ""), (92, "only three words"), (93, items[0][1]), (94, "the " * 30)]
    docs = [(0, None), (1, ""), (2, "only three words"), (3, "Only, three words!"), (4, "the " * 400), (5, items[1][1])]
    for d in range(10, 60):
        passage = rng.choice(items[:12])[1].split()
        kind = rng.randrange(4)
        if kind == 1:
            passage = passage[2:]
        elif kind == 2:
            passage.insert(len(passage) - 2, "extra")
        elif kind == 3:
            passage = words(5)
        docs.append((d, " ".join(words(rng.randint(0, 50)) + passage + words(rng.randint(0, 50))).title()))
    return docs, items


def test_leaks_match_brute_force(spark):
    docs, items = leaky(3)
    frame = spark.createDataFrame([*docs, docs[-1], (None, docs[5][1])], "doc_id long, text string").withColumn("mark", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): round(r["similarity"], 6) for r in decontaminate.leaks(frame, bench).collect()}
    expected = brute_leaks([*docs, (None, docs[5][1])], items)
    assert found == expected and len(expected) > 20
    kept = decontaminate.clean(frame, bench)
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in expected}
    assert kept.columns == ["doc_id", "text", "mark"]
    assert decontaminate.leaks(frame.limit(0), bench).count() == 0 == decontaminate.leaks(frame, bench.limit(0)).count()


@pytest.mark.parametrize("rows", [1_000_000, 0])
def test_leaks_with_and_without_broadcast(spark, monkeypatch, rows):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(decontaminate, "CHUNK", 16)
    docs, items = leaky(4)
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 6) for r in found.collect()} == brute_leaks(docs, items)


def test_fingerprints_lose_few_similar_windows(spark):
    """Share of the pairs that pass the radius, by similarity; the rest of the search is the same without one."""
    rng = random.Random(8)
    items, docs = [], []
    for i in range(150):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(20, 80))]
        items.append((i, " ".join(words)))
        for j in range(3):
            edited = list(words)
            for _ in range(rng.randint(0, len(words) // 40 + 1)):
                edited[rng.randrange(len(edited))] = f"x{rng.randrange(10**6)}"
            docs.append((3 * i + j, " ".join([f"y{rng.randrange(10**6)}" for _ in range(10)] + edited)))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {r["doc_id"] for r in decontaminate.leaks(*frames).collect()}
    every = {r["doc_id"]: r["similarity"] for r in decontaminate.leaks(*frames, radius=63).collect()}
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 1.01)):
        band = {d for d, s in every.items() if low <= s < high}
        assert len(band) > 20 and len(band & found) >= 0.98 * len(band)


def test_leaks_in_very_long_texts(spark):
    long_run = "the " * 300_000
    docs = [(1, long_run), (2, "x" * 5_000_000), (3, " " * 5_000_000), (4, "some words here " * 100_000 + "one two three four five six seven eight nine ten")]
    items = [(1, "the " * 30), (2, "one two three four five six seven eight nine ten")]
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"], r["similarity"], r["first_word"]) for r in found.collect()} == {(1, 1, 1.0, 0), (4, 2, 1.0, 300_000)}


def test_licences_inherit_from_the_nearest_folder(spark):
    rows = [
        ("a/LICENSE", "Released under the MIT License."),
        ("a/x.py", "some code"),
        ("a/b/x.py", "Intro.\nLicensed under the Apache License, Version 2.0.\n" + "code and words " * 20),
        ("a/b/y.py", None),
        ("a/b/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."),
        ("c/y.py", ""),
        (None, "nothing"),
        ("a/x.py", "some code"),
        ("d/z.py", "Copyright of nobody, a licence of none of these kinds at all"),
    ]
    files = spark.createDataFrame(rows, "path string, text string").withColumns({n: F.lit("clash") for n in ("licence", "mark", "folder", "given")})
    found = Counter((r["path"], r["licence"], r["basis"], r["inherited_from"]) for r in licences.scan(files).collect())
    assert found == Counter(
        [
            ("a/LICENSE", "MIT", "header", None),
            ("a/x.py", "MIT", "inherited", "a/LICENSE"),
            ("a/x.py", "MIT", "inherited", "a/LICENSE"),
            ("a/b/x.py", "Apache-2.0", "header", None),
            ("a/b/y.py", "GPL-3.0", "inherited", "a/b/COPYING.txt"),
            ("a/b/COPYING.txt", "GPL-3.0", "header", None),
            ("c/y.py", None, "none", None),
            (None, None, "none", None),
            ("d/z.py", None, "none", None),
        ]
    )
    assert licences.scan(files.limit(0)).count() == 0


LABELLED = [
    ("/* SPDX-License-Identifier: MIT */\nint main();", "MIT"),
    ("# SPDX-License-Identifier: BSD-3-Clause\n", "BSD-3-Clause"),
    ("// SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"),
    ("GNU General Public License version 2", "GPL-2.0"),
    ("# This file is licensed under the MIT license.\nimport os\n" + "x = 1\n" * 50, "MIT"),
    ("Distributed under the GPL v2 or later", "GPL-2.0"),
    ("Covered by the LGPL, version 2.1 or later", "LGPL-2.1"),
    ("This work is licensed under CC BY-ND 4.0.", "CC-BY-ND-4.0"),
    ("Licensed under CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0"),
    ("Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
    ("Mozilla Public License, v. 2.0", "MPL-2.0"),
    ("Boost Software License 1.0", "BSL-1.0"),
    ("GNU General Public License", None),
    ("Released under the BSD License", None),
    ("Copyright (c) 2020 Foo. All rights reserved.", None),
    ("The licence of this product was revoked by the court", None),
    ("He got his driving license in 1999, and with permission sold it.", None),
    ("All work is licensed to the company under a general agreement", None),
    ("SPDX-License-Identifier: LicenseRef-Own", None),
    ("no warranty was given, and the copyright of the song is held by its author", None),
]


def test_licences_of_labelled_texts(spark):
    own = [(n or None, t) for n, ts in TEMPLATES.items() for t in ts]
    wrapped = [(n, "/*\n * Copyright (C) 2019 A. Author\n *\n" + "\n".join(f" * {line}" for line in textwrap.wrap(t, 66)) + "\n */\nint x;\n" * 3) for n, t in own if len(t) > 200]
    rows = [(f"{i}/x.c", t, n) for i, (t, n) in enumerate(LABELLED + [(t, n) for n, t in own + wrapped])]
    found = licences.scan(spark.createDataFrame(rows, "path string, text string, label string")).collect()
    wrong = [(r["path"], r["label"], r["own_licence"]) for r in found if r["label"] != r["own_licence"]]
    assert not wrong, wrong


# Names under which a system may keep whole licence texts.
COMMON = {"Apache-2.0": "Apache-2.0", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.3": None}


@pytest.mark.skipif(not pathlib.Path("/usr/share/common-licenses").is_dir(), reason="no licence texts here")
def test_whole_licence_files(spark):
    folder = pathlib.Path("/usr/share/common-licenses")
    rows = [(f"{name}/LICENSE", (folder / name).read_text(errors="replace"), label) for name, label in COMMON.items() if (folder / name).is_file()]
    rows += [(f"{name}/src/a.c", "int x;", label) for name, label in COMMON.items() if (folder / name).is_file()]
    found = licences.scan(spark.createDataFrame(rows, "path string, text string, label string")).collect()
    wrong = [(r["path"], r["label"], r["licence"]) for r in found if r["label"] != r["licence"]]
    assert not wrong, wrong


def test_licences_in_very_long_texts(spark):
    rows = [("a/x", "x " * 2_000_000 + "\nReleased under the MIT License.\n"), ("a/y", "licence " * 500_000), ("a/z", "\n" * 3_000_000 + "warranty")]
    found = {r["path"]: r["licence"] for r in licences.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert found == {"a/x": "MIT", "a/y": None, "a/z": None}
