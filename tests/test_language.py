from __future__ import annotations

import random

import pytest

from factloom.functions import scalars as S
from factloom.plans.language import Both, Compare, Filter, Not, Spec, build, build_text, number_text, parse, pins_time, quote, tokenize


def error(text):
    found = parse(text)
    assert found.query is None
    assert 0 <= found.error.begin <= found.error.end <= max(8192, len(text.encode()))
    return found.error.message


@pytest.mark.parametrize(
    ("text", "part"),
    [
        ("", "nothing to run"), ("quakes banana", "wants a clause"), ("quakes within 50 of (1,2)", "unit"), ("quakes within 5km of (1)", "`,`"), ("quakes since -6", "wants its unit"),
        ("quakes since -6y", "no unit `y`"), ('quakes since "soon"', "ISO 8601"), ("quakes in bbox(1, 2)", "north edge"), ("quakes in bbox(1 2)", "`,`"), ("quakes where magnitude", "one of ="),
        ("quakes where " + "(" * 200 + "a=1" + ")" * 200, "deeper than 64"), ("quakes where " + "not " * 300 + "a=1", "deeper than 64"), ("q" * 20_000, "over 8192 bytes"), ("quakes limit 5000000000", "above 4000000000"),
        ("quakes since -99999999999999999999h", "beyond"), ("quakes where a = ", "right side of `=`"), ("quakes order magnitude", "`by`"), ("where", ""), ("42", "source"),
    ],
)
def test_errors_say_what_is_wrong(text, part):
    if text == "where":
        assert parse(text).query.source == "where"
    else:
        assert part in error(text)


def test_precedence_and_clauses():
    q = parse("quakes limit 3 where a > 1 or b = 2 and not c ~ x order by a.b desc").error
    assert "after `a`: wants a clause" in q.message
    q = parse("quakes limit 3.9 where a > 1 or b == 2 and not c ~ x order by mag desc since +90m as of -6h @ \"2026-03-01\"").query
    assert isinstance(q.where, Both) and q.where.op == "or" and q.where.right.op == "and" and isinstance(q.where.right.right, Not)
    assert (q.limit, q.order_by, q.descending) == (3, "mag", True)
    assert q.since.before_now == -5400 and q.valid_at.before_now == 21_600 and q.known_at.unix == 1_772_323_200
    assert parse("q where a>1 where b>2").query.where.field == "b"
    assert parse("quakes where limit > 3 and order = 1").query.fields() == ["limit", "order"]
    assert parse("quakes where properties.mag > 3").query.fields() == ["properties.mag"]
    assert parse("quakes where " + "(" * 20 + "a=1" + ")" * 20).query


def test_literals():
    q = parse("q where a = country:RU and b != 'it''s' ").error
    assert q is not None
    q = parse(r'q where a = country:RU and b != "say \"hi\"" and c = -4.5').query
    values = [c.literal for c in q.comparisons()]
    assert (values[0].key, values[0].text, values[1].text, values[2].number) == ("country", "RU", 'say "hi"', -4.5)
    q = parse("q within 2nm of port:SGSIN").query
    assert q.within.metres == 3704 and q.within.place == ("port", "SGSIN")
    assert parse("q in bbox(-1, -2, 3, 4)").query.bbox == (-1, -2, 3, 4)


def test_spans_are_bytes():
    tokens = tokenize('é "ü" >=')
    assert [(t.kind, t.begin, t.end) for t in tokens][-2:] == [(">=", 8, 10), ("end", 10, 10)]
    assert tokenize('a "open')[1].kind == "error"


def test_parser_is_total():
    rng = random.Random(1)
    words = ["quakes", "where", "and", "not", "(", ")", "a", ">", "1", "\"x", "'y'", "within", "5km", "of", ":", ",", "@", "as", "limit", "é", "\x00", "-", "+", "in", "bbox", "."]
    for _ in range(3000):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 14))) if rng.random() < 0.7 else "".join(chr(rng.randrange(300)) for _ in range(rng.randint(0, 40)))
        found = parse(text)
        assert (found.query is None) != (found.error is None)
        if found.error:
            assert 0 <= found.error.begin <= found.error.end <= len(text.encode())


def test_iso():
    assert S.parse_iso("2026-03-01T00:00:00Z") == 1_772_323_200
    assert S.parse_iso("2026-07-30") == 1_785_369_600
    assert S.parse_iso("2024-02-29T12:00:00.5+09:00") == 1_709_208_000
    assert S.parse_iso("2023-02-31") == S.parse_iso("2023-03-03")
    assert S.parse_iso("2023-13-01") is None and S.parse_iso("soon") is None
    assert S.store_time(1e18) == 2_147_483_647 and S.unix_time(S.store_time(5)) == 5


def test_builder_round_trip():
    spec = Spec("quakes", (Filter("magnitude", ">", "4.50", step=0.1), Filter("label", "~", 'a "b"', "text"), Filter("level", "=", "2", "enum")), (1.0, 2.25, 50.0), None, "-24h", "magnitude", True, 0)
    text = build_text(spec)
    assert text == 'quakes where magnitude > 4.5 and label ~ "a \\"b\\"" and level = 2 within 50km of (1, 2.25) since -24h order by magnitude desc limit 1'
    assert " ".join(t for t, _ in build(spec)) == text
    assert parse(text).query.comparisons()[1].literal.text == 'a "b"'
    assert number_text(0.1 + 0.2) == "0.3" and quote("x") == '"x"'
    assert pins_time("q as  OF -6h") and not pins_time('q where a = "as of"')


def test_jaro_winkler():
    assert S.jaro_winkler("", "") == 1 and S.jaro_winkler("abc", "") == 0
    assert S.jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.961, abs=1e-3)
    assert S.jaro_winkler("CENTRAL ITALY", "CENTRAL ITALIA") > 0.8 and S.jaro_winkler("TONGA", "ALASKA") < 0.6


def test_compare_nodes_carry_spans():
    text = "quakes where magnitude >= 4"
    node = parse(text).query.where
    assert isinstance(node, Compare) and text[node.begin : node.end] == "magnitude >= 4"
