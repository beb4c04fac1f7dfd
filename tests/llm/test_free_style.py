"""Brute-force checks of the operators that SQL can't express."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from factloom.llm import fingerprint, language, pii, simhash, substrings
from factloom.llm import queries as q

SCHEMA = "doc_id long, text string, lang string, source string"
ALPHABET = "abé \n"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "xx", "s") for i, t in enumerate(texts)], SCHEMA)


def brute_spans(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for d, raw in enumerate(raws):
        for p in range(len(raw) - length + 1):
            seen.setdefault(raw[p : p + length], []).append((d, p))
    spans = [[] for _ in raws]
    for places in seen.values():
        if len(places) > 1:
            for d, p in places:
                spans[d].append((p, p + length))
    return raws, [substrings.unite(s) for s in spans]


def made_texts(seed, n=40):
    rng = random.Random(seed)
    stock = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(10, 90))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            piece = rng.choice(stock)
            a = rng.randint(0, 20)
            parts.append(piece[a : a + rng.randint(5, 80)] if rng.random() < 0.6 else "".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 60))))
        texts.append("".join(parts))
    periodic = ["é" * 150, "ab" * 130 + "c", "x" + "ab" * 130, "abc" * 40 + "ab" + "abc" * 90, " " * 41, "  " * 300 + "q" + " " * 43, "-=" * 11]
    return [*texts, texts[0], None, "", "a" * 150, "a\x00" * 40, *periodic]


@pytest.mark.parametrize(("seed", "length", "hot"), [(1, 20, 10_000), (2, 20, 3), (3, 33, 2), (4, 12, 5)])
def test_substrings_match_brute_force(spark, seed, length, hot):
    texts = made_texts(seed)
    raws, spans = brute_spans(texts, length)
    found = {r["doc_id"]: r for r in substrings.remove(frame(spark, texts).repartition(5), length, hot, range_bytes=64).collect()}
    assert len(found) == len(texts)
    for d, (raw, mine) in enumerate(zip(raws, spans, strict=True)):
        kept, at = b"", 0
        for a, b in mine:
            kept, at = kept + raw[at:a], b
        kept += raw[at:]
        row = found[d]
        assert [(s["start"], s["stop"]) for s in row["spans"]] == mine
        assert (bytes(row["kept"]), row["n_bytes"], row["n_removed"], row["n_spans"]) == (kept, len(raw), len(raw) - len(kept), len(mine))


def test_substrings_of_repeated_rows_and_null_ids(spark):
    rows = [(None, "x" * 5 + "abcdefghijklmnopqrstuvwxyz", "", "")] * 2 + [(7, "abcdefghijklmnopqrstuvwxy", "", "")]
    found = substrings.remove(spark.createDataFrame(rows, SCHEMA), 20).select("doc_id", "n_removed").collect()
    assert sorted((r[0] is None, r[1]) for r in found) == [(False, 25), (True, 31), (True, 31)]
    assert substrings.remove(spark.createDataFrame([], SCHEMA)).count() == 0


def test_substrings_at_200_bytes_through_the_query(spark, tmp_path):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 9)))
    passages = [" ".join(word() for _ in range(70)) for _ in range(8)]
    texts = [" ".join([word() for _ in range(rng.randint(0, 60))] + rng.choices([*passages, " " * 700, "-" * 201, "= " * 450], k=rng.randint(0, 3)) + [word()]) for _ in range(60)]
    texts += [None, "", texts[3], "x" * 199, "x" * 200, "y" * 5000, "xyz" * 68]
    frame(spark, texts).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    raws, spans = brute_spans(texts, 200)
    found = {r["doc_id"]: r for r in q.op1_suffix_dedup(spark, str(tmp_path)).collect()}
    assert len(found) == len(texts) and any(spans)
    for d, (raw, mine) in enumerate(zip(raws, spans, strict=True)):
        kept, at = b"", 0
        for a, b in mine:
            kept, at = kept + raw[at:a], b
        kept += raw[at:]
        row = found[d]
        assert (row["n_bytes"], row["n_removed"], row["n_spans"], row["kept_sha256"]) == (len(raw), len(raw) - len(kept), len(mine), hashlib.sha256(kept).hexdigest())


def test_substrings_of_very_long_texts(spark):
    texts = [" " * 5_000_000, "ab" * 1_000_000, "".join(chr(97 + (i * i * 7919 >> 5) % 26) for i in range(3_000_000)), "- " * 300 + "end"]
    docs = frame(spark, texts).withColumns({n: F.lit("clash") for n in ("mark", "h", "d", "found", "kept")})
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in substrings.remove(docs).drop("kept", "spans").collect()}
    assert found[0] == (5_000_000, 5_000_000, 1) and found[1] == (2_000_000, 2_000_000, 1) and found[3] == (603, 600, 1)


def test_few_anchors_in_periodic_texts():
    for text in (b" " * 300_000, b"-=" * 150_000, b"0123456789" * 30_000):
        at, _ = substrings.anchors(np.frombuffer(text, np.uint8), np.zeros(1, np.int64), 200)
        assert len(at) < 4_000


def test_loser_tree_yields_common_prefixes():
    rng = random.Random(5)
    for ways in (1, 2, 3, 7):
        lists = [sorted({bytes(rng.choice(b"ab") for _ in range(24)) for _ in range(rng.randint(1, 60))}) for _ in range(ways)]
        runs = []
        for strings in lists:
            rows = np.frombuffer(b"".join(strings), np.uint8).reshape(-1, 24)
            common = substrings._common(rows)
            runs.append((common, rows[np.arange(24) >= common[:, None]].tobytes()))
        strings, owners, common = substrings.merge(runs, 24)
        assert strings == sorted(x for s in lists for x in s)
        for a, b, c in zip(strings, strings[1:], common[1:], strict=False):
            assert c == next((i for i in range(24) if a[i] != b[i]), 24)


def brute_fingerprint(text, words):
    tokens = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints, radius):
    least = list(range(len(prints)))

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                least[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def test_simhash_matches_brute_force(spark):
    rng = random.Random(3)
    words = [f"W{i}Ä" for i in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    for _ in range(60):
        copy = rng.choice(texts).split(" ")
        copy[rng.randrange(len(copy))] = rng.choice(words)
        texts.append("\t".join(copy))
    texts += [None, "", " \n", texts[3]]
    found = {r["doc_id"]: r for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    prints = [brute_fingerprint(t, 4) for t in texts]
    classes = brute_classes(prints, 4)
    assert len(found) == len(texts)
    for i, (p, c) in enumerate(zip(prints, classes, strict=True)):
        assert (found[i]["fp"] & (2**64 - 1), found[i]["component_id"]) == (p, c)


@pytest.mark.parametrize("hot", [20_000, 4])
def test_links_keep_every_component(spark, hot):
    rng = random.Random(9)
    prints = []
    for _ in range(25):
        seed = rng.getrandbits(64)
        for _ in range(rng.randint(1, 30)):
            prints.append(seed ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 6))}))
    prints = list(dict.fromkeys(prints))
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    found = simhash.classes(spark.createDataFrame(rows, "doc_id long, fp long"), 4, hot).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == dict(enumerate(brute_classes(prints, 4)))


def test_simhash_of_very_long_texts_and_clashing_columns(spark):
    texts = ["x " * 1_000_000, " " * 5_000_000, "y" * 5_000_000, None, "x " * 999_999 + "x"]
    docs = frame(spark, texts).withColumns({n: F.lit("clash") for n in ("fp", "root", "least", "node", "component_id")})
    found = {r["doc_id"]: (r["fp"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert found[0] == found[4] and found[0][1] == 0 and found[1] == found[3] == (0, 1) and found[2][1] == 2
    assert found[0][0] & (2**64 - 1) == brute_fingerprint("x x x x x x", 4)


def test_simhash_of_nothing(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sketches_recover_differences():
    rng = random.Random(1)
    sets = [np.array(sorted({rng.getrandbits(64) for _ in range(rng.randint(0, 300))}), np.uint64) for _ in range(60)]
    other = [np.array(sorted(set(rng.sample(s.tolist(), len(s) // rng.choice([1, 2, 30]))) | {rng.getrandbits(64) for _ in range(rng.choice([0, 9, 900]))}), np.uint64) for s in sets]
    raw = fingerprint.Prints.of(sets + other).raw()
    prints = fingerprint.Prints.load(raw)
    assert prints.raw() == raw and [x.tolist() for x in prints.recovered(np.arange(60))] == [s.tolist() for s in sets]
    for (x, y), a, b in zip(prints.differences(np.arange(60), np.arange(60, 120)), sets, other, strict=True):
        assert (set(x.tolist()), set(y.tolist())) == (set(a.tolist()) - set(b.tolist()), set(b.tolist()) - set(a.tolist()))


def brute_digests(text):
    pieces = []
    for line in text.split("\n") if text else []:
        pieces += [line] if len(line) <= 320 else re.findall(r"[^.!?]+[.!?]*|[.!?]+", line)
    out = set()
    for piece in set(pieces):
        n = pieces.count(piece)
        out |= {xxhash.xxh64_intdigest(piece, k) for k in [2**j for j in range(40) if 2**j <= n] + [n]}
    return out


def test_fingerprints_follow_the_next_document(spark):
    rng = random.Random(2)
    texts = ["of none", "of none either"] + ["".join(rng.choice("ab .\né") for _ in range(rng.choice([0, 50, 200, 900]))) for _ in range(70)] + [None, "", "x. " * 200, "\n" * 300]
    ids = [None, None, *rng.sample(range(-50, 200), len(texts) - 2)]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    clash = docs.withColumns({n: F.lit("clash") for n in ("h", "head", "bucket", "fingerprint", "k")})
    found = {r["n_chars"] if r["doc_id"] is None else (r["doc_id"],): r for r in fingerprint.fingerprint(clash, 1500).collect()}
    hashes = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(zip(ids, texts, strict=True), key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    prints = {}
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        row = found[len(text) if i is None else (i,)]
        assert (row["n_chars"], row["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(text, row["fingerprint"]) == row["fingerprint"]
        own, new, following = (brute_digests(t) for t in (text, edited, after))
        raw = [base64.b64decode(row[c]) for c in ("fingerprint", "edited_fingerprint")]
        stored = fingerprint.Prints.load(raw)
        assert [set(x.tolist()) for x in stored.recovered(np.arange(2))] == [own, new]
        assert row["near_edited"] == (len(own & new) / len(own | new) if own | new else 1.0)
        assert row["near_next"] == (len(own & following) / len(own | following) if own | following else 1.0)
        assert (row["removed"], row["added"]) == tuple(",".join(f"{x:016x}" for x in sorted(s)) for s in (own - new, new - own))


def test_fingerprints_of_very_long_texts(spark):
    texts = ["\n" * 5_000_000, "x" * 5_000_000, "x. " * 1_500_000, " " * 5_000_000, "".join(f"line {i}\n" for i in range(300_000))]
    rows = {r["doc_id"]: r for r in fingerprint.fingerprint(frame(spark, texts)).collect()}
    assert [rows[i]["n_chars"] for i in range(5)] == [len(t) for t in texts]
    assert rows[4]["near_edited"] == pytest.approx(0.5, abs=0.03) and rows[0]["near_next"] < 0.1


def test_fingerprints_over_many_ranges(spark):
    docs = frame(spark, [f"text {i}. " * 30 for i in range(300)])
    one, many = ({r["doc_id"]: r["edited_sha256"] for r in fingerprint.fingerprint(docs, size).collect()} for size in (16 << 20, 4096))
    assert one == many and len(one) == 300
    assert fingerprint.fingerprint(docs.limit(0)).count() == 0


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def test_pii_base_matches_plain_patterns():
    rng = random.Random(4)
    for _ in range(5000):
        text = "".join(rng.choice("a.@-1 2+_5") for _ in range(rng.randint(0, 40)))
        spans = pii.base_spans(text)
        assert [s[1:] for s in spans if s[0] == "email"] == [m.span() for m in EMAIL.finditer(text)]
        fine = [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
        assert [s[1:] for s in spans if s[0] == "ip"] == fine
        digits = lambda m: re.sub("[^0-9]", "", m[0])
        fine = [m.span() for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and plain_luhn(digits(m))]
        assert [s[1:] for s in spans if s[0] == "card"] == fine
        fine = [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
        assert [s[1:] for s in spans if s[0] == "phone"] == fine


def plain_luhn(digits):
    doubled = [int(d) for d in digits[-1::-2]] + [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return sum(doubled) % 10 == 0


CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def test_pii_cards_and_phones_match_plain_patterns():
    rng = random.Random(7)
    seen = Counter()
    for _ in range(4000):
        text = "".join(rng.choice(["4", "1", "0", "7", " ", "-", "(", ")", ".", " x ", "+", "+4"] + ["11", "23"] * 5) for _ in range(rng.randint(8, 40)))
        spans = pii.base_spans(text)
        digits = lambda m: re.sub("[^0-9]", "", m[0])
        for kind, pattern, fine in (("card", CARD, lambda d: 12 <= len(d) <= 19 and plain_luhn(d)), ("phone", PHONE, lambda d: 9 <= len(d) <= 15)):
            expected = [m.span() for m in pattern.finditer(text) if fine(digits(m))]
            assert [s[1:] for s in spans if s[0] == kind] == expected
            seen[kind] += len(expected)
    assert min(seen.values()) > 50


def test_pii_added_spans_match_a_plain_rule():
    """Random texts of parts whose spans are known: disguised ones must be added, plain ones and prose not."""
    rng = random.Random(11)
    spell = {"en": "zero one two three four five six seven eight nine", "de": "null eins zwei drei vier fünf sechs sieben acht neun", "fr": "zéro un deux trois quatre cinq six sept huit neuf", "es": "cero uno dos tres cuatro cinco seis siete ocho nueve"}
    plus = {"en": "plus", "de": "plus", "fr": "plus", "es": "más"}
    for _ in range(300):
        text, base, added = "", [], []
        for _ in range(rng.randint(0, 8)):
            kind = rng.randrange(6)
            lang = rng.choice(list(spell))
            if kind == 0:
                part = f"{rng.choice('abc')}bob@ex{rng.randrange(99)}.org"
                base.append(("email", len(text), len(text) + len(part)))
            elif kind == 1:
                at = rng.choice(["(at)", "[ AT ]", "{arroba}", "at", "arobase", "@"])
                dot = rng.choice(["[dot]", "(.)", "dot", "punto", "point"])
                part = f"bob {at} ex dot com" if at == "@" else f"bob {at} ex {dot} com"
                part = part.replace(" @ ", "@")
                added.append(("email", len(text), len(text) + len(part)))
            elif kind == 2:
                digits = "".join(rng.choice("0123456789") for _ in range(11))
                part = " ".join([plus[lang], *(spell[lang].split()[int(d)] for d in digits)])
                added.append(("phone", len(text), len(text) + len(part)))
            elif kind == 3:
                part = "\U0001d41b\U0001d428\U0001d41b@ex.org"
                added.append(("email", len(text), len(text) + len(part)))
            else:
                part = rng.choice(["See you at home.", "uno dos tres", "un point", "é", "Meet at noon (at best)"])
            text += part + rng.choice([" ; ", "\n", " / "])
        found = pii.base_spans(text)
        assert [s for s in found if s[0] == "email"] == base
        order = lambda s: (s[1], pii.KINDS.index(s[0]), s[2])
        assert pii.all_spans(text, found) == sorted({*found, *added} - {s for s in found if s not in base}, key=order)


@pytest.mark.parametrize("text", [" " * 2_000_000 + "(", "(" + " " * 2_000_000, "a@" * 500_000, "+1 " * 500_000, "1" * 2_000_000, "1." * 1_000_000, "one " * 500_000, "x at " * 400_000, "at dot " * 300_000, "a@b.c " * 100_000 + "b [at] c [dot] d " * 50_000, "а" * 500_000, "x" * 5_000_000])
def test_pii_in_very_long_texts_is_linear(text):
    begin = time.perf_counter()
    spans = pii.all_spans(text, pii.base_spans(text))
    assert time.perf_counter() - begin < 30 and all(a < b for _, a, b in spans)


@pytest.mark.parametrize(
    ("text", "kind", "part"),
    [
        ("mail bob [at] example (dot) com now", "email", "bob [at] example (dot) com"),
        ("write bob at example dot com", "email", "bob at example dot com"),
        ("аlice@exаmple.com", "email", "аlice@exаmple.com"),
        ("é 192 dot 168 dot 1 dot 7", "ip", "192 dot 168 dot 1 dot 7"),
        ("x ４１１１１１１１１１１１１１１１", "card", "４１１１１１１１１１１１１１１１"),
        ("plus one nine eight eight five five five two four eight five", "phone", "plus one nine eight eight five five five two four eight five"),
        ("bo​b@example.com", "email", "bo​b@example.com"),
        ("bob [at] example dot com", "email", "bob [at] example dot com"),
        ("x bob@example dot com", "email", "bob@example dot com"),
        ("bob at example [dot] com", "email", "bob at example [dot] com"),
        ("bob (arroba) example (punto) com", "email", "bob (arroba) example (punto) com"),
        ("bob at " + "e" * 64 + " dot com", "email", "bob at " + "e" * 64 + " dot com"),
        ("\U0001d7d9\U0001d7da.0.0.1 x", "ip", "\U0001d7d9\U0001d7da.0.0.1"),
        ("más tres cuatro nueve uno dos tres cuatro cinco seis siete", "phone", "más tres cuatro nueve uno dos tres cuatro cinco seis siete"),
    ],
)
def test_pii_disguises(text, kind, part):
    found = pii.all_spans(text, pii.base_spans(text))
    assert (kind, text.index(part), text.index(part) + len(part)) in found


def test_pii_leaves_prose_alone():
    text = "Look at the dot. One two, three apples at home; call me at five. Meet at noon (at best)."
    assert pii.all_spans(text, []) == []
    assert pii.redact("a bob@x.org, b") == "a <EMAIL>, b"


def test_pii_rows(spark):
    texts = ["a@b.c 1.2.3.4", None, "", "a@b.c 1.2.3.4"]
    docs = frame(spark, texts).withColumn("spans", F.lit(1))
    found = {r["doc_id"]: r for r in pii.find(docs).collect()}
    assert found[0]["spans"] == "email:0:5,ip:6:13" and found[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert found[0]["base_sha256"] == hashlib.sha256(b"email:0:5,ip:6:13").hexdigest()
    assert pii.find(docs.limit(0)).count() == 0


def test_language_on_held_out_rows(spark):
    found = q.op2_language_id(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").where("held_out").collect()
    assert len(rows) > 100
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, "el perro"), (2, None), (3, "12 !"), (4, "² ½"), (5, "perrito")], "doc_id long, text string")
    none = language.fit(spark.createDataFrame([], "text string, lang string"))
    assert {r["lang_pred"] for r in language.predict(docs, none).collect()} == {"und"}
    model = language.fit(spark.createDataFrame([("el perro come", "es"), ("the dog eats", "en"), ("x", None), (None, "fr")], "text string, lang string"))
    assert [r["lang_pred"] for r in language.predict(docs, model).orderBy("doc_id").collect()] == ["es", "und", "und", "und", "es"]
