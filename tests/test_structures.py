"""Automata, spans, leaders and averages against brute force in sequence."""

import random
import re
from difflib import SequenceMatcher

import pytest

from fieldloom.operators import gazetteer, similarity, spans, summaries


def brute_words(names, texts):
    out = []
    keys = {" ".join(gazetteer.words_of(n)) for n in names if n and gazetteer.words_of(n)}
    for i, t in texts:
        found = list(re.finditer(r"[^\W_]+", t or ""))
        for a in range(len(found)):
            for b in range(a + 1, min(len(found), a + 8) + 1):
                key = " ".join(m[0].lower() for m in found[a:b])
                if key in keys:
                    out.append((i, key, found[a].start(), found[b - 1].end()))
    return sorted(out)


def test_automaton_finds_every_occurrence():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("ab") for _ in range(rng.randint(0, 25)))
        names = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 8))})
        got = sorted((names[p], a, b) for p, a, b in gazetteer.Automaton(names).find(text))
        assert got == sorted((n, a, a + len(n)) for n in names for a in range(len(text)) if text.startswith(n, a))


NAMES = ["Gulf of Kutch", "gulf", "of", "Kutch", "Kutch reef", "the gulf of kutch reef flat", "Île d'Yeu", "", None, " - ", "GULF  OF-KUTCH", "a a", "a a a"]
TEXTS = [(1, "Seen in the Gulf of Kutch reef flat; gulf-of kutch, GULF OF KUTCH."), (2, None), (3, ""), (4, "île d'yeu a_a a a a"), (5, "gulfofkutch"), (6, "of " * 60 + "Kutch"), (1, "gulf"), (None, "the kutch reef")]


@pytest.mark.parametrize("bound", [gazetteer.SYMBOLS, 3])
def test_names_of_any_number_of_words(spark, bound):
    names = spark.createDataFrame([(n, 1) for n in NAMES], "n string, key int")
    texts = spark.createDataFrame([(*t, "x") for t in TEXTS], "id long, t string, name string").repartition(3)
    found = gazetteer.occurrences(names, "n", texts, "id", "t", bound=bound)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(brute_words(NAMES, [t for t in TEXTS if t[0] is not None]) + [(None, k, a, b) for _, k, a, b in brute_words(NAMES, [(0, TEXTS[-1][1])])], key=repr)
    pairs = {tuple(r) for r in gazetteer.mentions(names, "n", texts, "id", "t", bound=bound).collect()}
    assert {(1, "Gulf of Kutch"), (1, "GULF  OF-KUTCH"), (4, "Île d'Yeu"), (None, "Kutch reef"), (4, "a a a")} <= pairs and not any(i in (2, 3, 5) for i, _ in pairs)


def test_characters_and_empty_tables(spark):
    names = spark.createDataFrame([("ring",), ("in",), ("STRING",)], "n string")
    texts = spark.createDataFrame([(1, "String rings"), (2, "x")], "id long, t string")
    got = {tuple(r) for r in gazetteer.occurrences(names, "n", texts, "id", "t", "character").collect()}
    assert got == {(1, "string", 0, 6), (1, "ring", 2, 6), (1, "in", 3, 5), (1, "ring", 7, 11), (1, "in", 8, 10)}
    assert gazetteer.occurrences(names.limit(0), "n", texts, "id", "t").count() == 0
    assert gazetteer.mentions(names, "n", texts.limit(0), "id", "t").count() == 0


def test_area_lookup(spark):
    areas = spark.createDataFrame([(1, "Okha Port", "J"), (2, "okha", "D"), (3, "", "Z"), (4, None, "Z"), (5, "Mandvi", "K"), (6, "mandvi", "L")], "o int, area string, district string")
    asked = spark.createDataFrame([("OKHA ",), ("okha po",), ("near Mandvi beach",), ("nowhere",), ("",), (None,)], "q string")
    got = {r["query"]: (r["match"], r["district"]) for r in gazetteer.area_lookup(asked, "q", areas, "area", ["o"], ["district"]).collect()}
    assert got == {"okha": ("exact", "D"), "okha po": ("part", "J"), "near mandvi beach": ("part", "K")}


def fold(rows):
    kept = []
    for x in rows:
        for k in kept:
            if x[0] < k[1] and x[1] > k[0]:
                if x[2] > k[2]:
                    kept.remove(k)
                    kept.append(x)
                break
        else:
            kept.append(x)
    return kept


def some_spans(seed, n):
    rng = random.Random(seed)
    return [(d, i, a, a + rng.choice([0, 1, 3, 5, 20]), rng.choice([0.5, 0.7, 0.9])) for d in range(6) for i in range(n) for a in [rng.randint(0, 40)]]


@pytest.mark.parametrize("n", [3, 12, 40])
def test_overlaps_as_by_the_fold_in_order(spark, n):
    rows = some_spans(n, n)
    df = spark.createDataFrame(rows, "doc long, i int, start int, stop int, confidence double").repartition(3)
    got = sorted(map(tuple, spans.resolve_overlaps(df, "doc", ["i"]).collect()))
    want = []
    for d in range(6):
        own = [r for r in rows if r[0] == d]
        want += [own[x[3]] for x in fold([(r[2], r[3], r[4], j) for j, r in enumerate(own)])]
    assert got == sorted(want)


def test_leftmost_longest(spark):
    rows = some_spans(9, 15)
    df = spark.createDataFrame(rows, "doc long, i int, start int, stop int, confidence double")
    got = sorted((r["doc"], r["start"], r["stop"]) for r in spans.leftmost_longest(df, "doc").collect())
    want = []
    for d in range(6):
        end = -1
        for a, b in sorted({(r[2], r[3]) for r in rows if r[0] == d and r[2] != r[3]}, key=lambda s: (s[0], -s[1])):
            if a >= end:
                want.append((d, a, b))
                end = b
    assert [g for g in got if g[1] != g[2]] == sorted(want)


def merged(pieces, gap=2):
    out = []
    for word, label, score, start, stop in pieces:
        word, score, start, stop = (word or "").replace("##", "").strip(), 1.0 if score is None else score, start or 0, stop or 0
        if not word:
            continue
        if out and out[-1][1] == label and start - out[-1][4] <= gap:
            last = out[-1]
            out[-1] = (f"{last[0]} {word}", label, (last[2] + score) / 2, last[3], stop)
        else:
            out.append((word, label, score, start, stop))
    return out


def test_subwords_merge_in_sequence(spark):
    rng = random.Random(4)
    pieces = {d: [(rng.choice(["Ac", "##rop", "ora", "##", " ", None, "sp"]), rng.choice(["A", "B", None]), rng.choice([None, 0.5, 0.25, 0.9]), s, s + rng.randint(1, 4)) for s in sorted(rng.randint(0, 60) for _ in range(25))] for d in (1, 2, None)}
    df = spark.createDataFrame([(d, i, *p) for d, ps in pieces.items() for i, p in enumerate(ps)], "doc long, at int, word string, label string, score double, start int, stop int").repartition(3)
    got = {}
    for r in spans.merge_subwords(df, "doc", ["at"]).orderBy("n").collect():
        got.setdefault(r["doc"], []).append((r["word"], r["label"], r["score"], r["start"], r["stop"]))
    assert got == {d: merged(ps) for d, ps in pieces.items()}
    assert spans.merge_subwords(df.limit(0), "doc", ["at"]).count() == 0


def test_spans_of_a_pattern(spark):
    texts = [(1, "Aa bb Cc. ééé Dd"), (2, ""), (3, None), (4, "none"), (5, "Aa"), (6, "x" * 5000 + "Aa" * 200)]
    df = spark.createDataFrame(texts, "id long, t string")
    got = sorted(map(tuple, spans.matches(df, "id", "t", "[A-Z][a-z]").collect()))
    assert got == sorted((i, m.start(), m.end(), m[0]) for i, t in texts if t for m in re.finditer("[A-Z][a-z]", t))


def leaders(keys, threshold):
    out, chosen = {}, []
    for k in sorted(keys):
        lead = next((x for x in chosen if 100 * SequenceMatcher(None, x.lower().strip(), k.lower().strip()).ratio() > threshold), None)
        if lead is None:
            chosen.append(k)
        out[k] = k if lead is None else lead
    return out


def test_leaders_are_those_of_the_sequence(spark):
    rng = random.Random(2)
    stems = ["cassiopea andromeda::narara", "elysia obtusa::okha", "aplysia::mandvi"]
    rows = []
    for block in ("d", "e", None):
        for _ in range(40):
            word = list(rng.choice(stems))
            for _ in range(rng.randint(0, 5)):
                word[rng.randrange(len(word))] = rng.choice("abcdefgh ")
            rows.append((block, rng.choice(["", " "]) + "".join(word).title() if rng.random() < 0.2 else "".join(word)))
    rows += [("d", ""), ("d", "  "), ("d", None), ("e", rows[0][1]), ("d", rows[0][1])]
    df = spark.createDataFrame(rows, "block string, k string").repartition(3)
    got = {(r["block"], r["k"]): r["leader"] for r in similarity.greedy_clusters(df, ["block"], "k").collect()}
    want = {(b, k): lead for b in ("d", "e", None) for k, lead in leaders({k for x, k in rows if x == b and k is not None}, 88).items()}
    assert got == want


def test_average_is_that_of_the_sequence(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 2, None]), i // 2, rng.choice([None, rng.random() * 100]), "x") for i in range(500)] + [(7, 0, 4.0, "x")]
    df = spark.createDataFrame(rows, "g long, at long, v double, x string").repartition(5)
    want = {}
    for g in (1, 2, None, 7):
        own = [v for _, v in sorted((a, v) for k, a, v, _ in rows if k == g and v is not None)]
        e = own[0]
        for x in own[1:]:
            e = 0.3 * x + 0.7 * e
        want[g] = (e, len(own))
    for bits in (0, 2, 12):
        got = {r["g"]: (r["ema"], r["n"]) for r in summaries.moving_average(df, ["g"], ["at"], "v", block_bits=bits).collect()}
        assert got.keys() == want.keys() and all(got[g][1] == want[g][1] and got[g][0] == pytest.approx(want[g][0], rel=1e-9) for g in want)
    assert summaries.moving_average(df.limit(0), ["g"], ["at"], "v").count() == 0


def test_articles_as_variant(spark):
    import json

    from fieldloom.operators import articles

    bodies = ['{"b": 1, "a": {"x": [1, "é"]}}', '{"b": "text"}', "{broken", None, "[1, 2]", "3", "{}"]
    rows = articles.article_bodies(spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string"), "body")
    told = articles.article_fields(rows, {"b": ("$.b", "int"), "x": ("$.a.x[1]", "string")})
    got = {r["i"]: r for r in told.select("i", "malformed", "b", "x", articles.article_text("article").alias("text"), articles.article_text(articles.article_changed("article", b=told["i"], new=told["body"])).alias("changed")).collect()}
    assert [got[i]["malformed"] for i in range(7)] == [False, False, True, False, False, False, False]
    assert (got[0]["b"], got[0]["x"], got[1]["b"], got[2]["b"]) == (1, "é", None, None)
    # encoded and decoded again, nothing is lost
    assert all(json.loads(got[i]["text"]) == json.loads(bodies[i]) for i in (0, 1, 4, 5, 6)) and got[2]["text"] is None
    assert json.loads(got[0]["changed"]) == {"a": {"x": [1, "é"]}, "b": 0, "new": bodies[0]}
    assert json.loads(got[5]["changed"]) == {"b": 5, "new": "3"}
    schema = articles.article_schema(rows.where("i < 2").selectExpr("1 AS g", "article"), ["g"]).first()["schema"]
    assert "a: OBJECT<x: ARRAY" in schema and "b: VARIANT" in schema
