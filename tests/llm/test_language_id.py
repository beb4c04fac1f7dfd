"""Language identification against a plain version of its rule."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from factloom.llm import language


def plain_model(rows, floor=-16.0):
    words, grams = defaultdict(Counter), defaultdict(Counter)
    for text, lang in {r for r in rows if None not in r}:
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            words[lang][w] += 1
    for lang, counts in words.items():
        for w, n in counts.items():
            p = "\x01" + w + "\x01"
            for k in range(1, 5):
                for i in range(len(p) - k + 1):
                    grams[lang][p[i : i + k]] += n
    kept = [{lang: {k: n for k, n in c.items() if n >= 2} for lang, c in table.items()} for table in (words, grams)]
    langs = sorted(words)

    def logs(table, key):
        if not any(key in table[x] for x in langs):
            return None
        return [math.log(table[x][key] / sum(table[x].values())) if key in table[x] else floor for x in langs]

    def predict(text):
        found = re.findall(r"[^\W\d_]+", (text or "").lower())
        if not found:
            return "und", 0.0
        total = [0.0] * len(langs)
        for w in found:
            scores = logs(kept[0], w)
            if scores is None:
                p, at, steps = "\x01" + w + "\x01", 0, []
                while at < len(p):
                    for k in (4, 3, 2, 1):
                        gram = p[at : at + k]
                        if len(gram) == k and logs(kept[1], gram):
                            steps.append(logs(kept[1], gram))
                            break
                    else:
                        k = 1
                        steps.append([floor] * len(langs))
                    at += max(1, k - 1)
                scores = [0.5 * sum(s[i] for s in steps) / len(steps) for i in range(len(langs))]
            total = [a + b for a, b in zip(total, scores, strict=True)]
        best = max(range(len(langs)), key=lambda i: (total[i], -i))
        scale = 50 / (50 + len(found))
        return langs[best], 1 / sum(math.exp(max(-700, scale * (x - total[best]))) for x in total)

    return predict


def made(seed):
    rng = random.Random(seed)
    letters = {"xa": "abcde", "xb": "cdefg", "xc": "éèàab"}
    word = lambda lang: "".join(rng.choice(letters[lang]) for _ in range(rng.randint(1, 6)))
    return [(" ".join(word(lang) for _ in range(rng.randint(0, 30))), lang) for lang in letters for _ in range(15)]


def test_against_a_plain_version(spark):
    rows = made(1)
    fitted = [*rows, rows[0], rows[0], ("aaa bbb", None), (None, "xa")]
    model = language.fit(spark.createDataFrame(fitted, "text string, lang string").repartition(3))
    predict = plain_model(fitted)
    texts = [t for t, _ in made(2)] + [None, "", "12 !", "a" * 64 + "g" * 500, "zzz qqq", "ab" * 40_000, "c d " * 30_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(docs, model).collect()}
    for i, text in enumerate(texts):
        lang, score = predict(text)
        assert found[i][0] == lang and found[i][1] == pytest.approx(score, abs=1e-9)


def test_a_long_word_is_read_to_its_end(spark):
    model = language.fit(spark.createDataFrame([("a a a", "la"), ("b b b", "lb")], "text string, lang string"))
    assert model.predict("a" * 64 + "b" * 500, {})[0] == "lb"


def test_clashing_columns_and_empty_tables(spark):
    model = language.fit(spark.createDataFrame(made(3), "text string, lang string"))
    docs = spark.createDataFrame([(1, "abc", "x", 0.5, "y")], "doc_id long, text string, lang_pred string, score double, entry string")
    out = language.predict(docs, model)
    assert out.columns == ["doc_id", "entry", "lang_pred", "score"] and out.first()["lang_pred"] in ("xa", "xb", "xc")
    assert language.predict(docs.limit(0), model).count() == 0 and language.keep(docs.limit(0), model).count() == 0
    assert language.keep(docs.withColumn("text", F.lit(None).cast("string")), model).count() == 0


def test_fitted_rows_are_bounded_and_copies_are_one(spark):
    rows = [(f"w{i % 26:c}" * 3, "xa") for i in range(97, 123)] + [("same text here", "xb")] * 500
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"), fit_rows=400)
    assert "same" not in model.words
