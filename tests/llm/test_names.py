import pytest
from pyspark.sql import functions as F

from quillspark import schemas
from quillspark.llm import names as N

ROWS = [
    (["Theodora Varekarhurst", "Dora Varekarhurst", "Varekarhurst, Dora", "T. Varekarhurst"], "Theodora Varekarhurst: harbour row"),
    (["Theodora A. Varekarhurst", "Theodora Varékarhurst", "Theodira Varekarhurst"], None),
    (["Patricia Gonakuvhurst", "Theodora Gonakuvhurst", "Gonakuvhurst"], "water inquiry"),
    (["Fisedorworth Insurance Federation", "FISEDORWORTH INSURANCE FEDERATION", "Insurance Federation of Fisedorworth", "Fisedorworth Insurance Fed."], "Upper Dray water inquiry"),
    (["Fisedorworth Railway Brothers", "Fisedorworth Railway Bros.", "the Fisedorworth Railway Brothers"], "WATER INQUIRY"),
    (["Upper Dray", "  ", None, "UK"], ""),
    (None, None),
] * 2


def classes(spark, rows):
    df = spark.createDataFrame(rows, "named_entities array<string>, event_label string").withColumns({"id": F.lit(3), "token": F.lit("t"), "n": F.lit(0), "spelling": F.lit("s")})
    out = {}
    for r in N.link_names(df).collect():
        out.setdefault(r["class_id"], set()).add(r["spelling"])
    return list(out.values())


def test_links_variants_and_keeps_others_apart(spark):
    got = classes(spark, ROWS)
    theodora = next(c for c in got if "Theodora Varekarhurst" in c)
    assert theodora == {"Theodora Varekarhurst", "Dora Varekarhurst", "Varekarhurst, Dora", "T. Varekarhurst", "Theodora A. Varekarhurst", "Theodora Varékarhurst", "Theodira Varekarhurst"}
    insurance = next(c for c in got if "Fisedorworth Insurance Federation" in c)
    assert insurance == {"Fisedorworth Insurance Federation", "FISEDORWORTH INSURANCE FEDERATION", "Insurance Federation of Fisedorworth", "Fisedorworth Insurance Fed."}
    assert {"Fisedorworth Railway Brothers", "Fisedorworth Railway Bros.", "the Fisedorworth Railway Brothers"} in got
    # A surname that two persons have belongs to neither; places and general phrases stay alone.
    for alone in ("Gonakuvhurst", "Patricia Gonakuvhurst", "Theodora Gonakuvhurst", "Upper Dray", "water inquiry", "Upper Dray water inquiry", "WATER INQUIRY", "UK"):
        assert {alone} in got


def test_an_initial_isnt_another_name(spark):
    got = classes(spark, [(["Dorothy Helatondale", "Kofi Helatondale", "Kofi D. Helatondale", "Dot Helatondale", "K. Helatondale", "K. D. Helatondale"], None), (["Kofi Baresen", "Dorothy Vonamley", "Dorothy Kisep"], None)])
    assert {"Dorothy Helatondale", "Dot Helatondale"} in got
    assert {"Kofi Helatondale", "Kofi D. Helatondale", "K. Helatondale", "K. D. Helatondale"} in got


def test_empty(spark):
    empty = spark.createDataFrame([], schemas.STORY_SIGNALS)
    assert N.link_names(empty).count() == 0
    assert N.name_pairs(empty).count() == 0


@pytest.mark.parametrize(
    ("a", "b", "errors"),
    [("riselepholt", "riselephptl", 2), ("selemuzden", "sekemuuzden", 2), ("tessa", "tssa", 1), ("pellalarey", "belalarey", 9), ("laralupholt", "waralupholt", 9), ("leletorski", "lelotopski", 9), ("mei", "mri", 1), ("uk", "us", 9)],
)
def test_typing_errors(a, b, errors):
    assert N.typing_errors(a, b) == errors == N.typing_errors(b, a)


def test_token_join_finds_what_brute_force_finds(spark):
    import random

    rnd = random.Random(4)
    words = {"".join(rnd.choice("abdelorst") for _ in range(rnd.randint(3, 9))) for _ in range(150)}
    for w in list(words)[:60]:
        i = rnd.randrange(len(w))
        words.add(w[:i] + w[i + 1 :])
    got = {(r["a"], r["b"]) for r in N.similar_tokens(spark.createDataFrame([(w,) for w in words], "token string")).collect()}
    want = {(a, b) for a in words for b in words if a != b and len(a) > 2 and len(b) > 2 and N.typing_errors(a, b) < 9}
    assert got == want


def test_reading():
    assert N.read("Prof. Anthony “Tony” Smith-Jones (ASJ)") == ([["anthony", "smith", "jones"], ["anthony", "smithjones"]], "tony anthony")
    assert N.read("Dr")[0] == [["dr"]]
    assert N.read("...")[0] == [[]]


def test_given_names_of_a_frequent_surname_meet(spark):
    # The surname is in nearly all spellings, so given names are the only heavy tokens.
    others = [f"{chr(97 + i % 26)}{'aeiou'[i % 5]}{chr(98 + i // 26)}bokul Smith" for i in range(60)]
    got = classes(spark, [([*others, "Hetty Smith", "Henrietta Smith", "Wm Smith", "William Smith", "Quentin Smith", "Q. Smith"], None)])
    for same in ({"Hetty Smith", "Henrietta Smith"}, {"Wm Smith", "William Smith"}, {"Quentin Smith", "Q. Smith"}):
        assert same in got


def test_candidates_hold_all_that_brute_force_accepts(spark):
    import random

    rnd = random.Random(8)
    given, last = "henrietta hetty henrieta h william wm will w j s".split(), "smith smth smiht sm jones jnes s j".split()
    spelled = sorted({tuple(rnd.sample(given, rnd.randint(0, 2)) + rnd.sample(last, rnd.randint(1, 2))) for _ in range(160)})
    weight = {t: 0.5 if len(t) == 1 else 1.0 + rnd.random() * 5 for t in {*given, *last}}
    nicks = {k: set(v.split()) for k, v in N.NICKNAMES.items()}
    known = spark.createDataFrame([(k, x) for k, v in nicks.items() for x in v], "token string, b string")
    tokens = spark.createDataFrame([(t,) for t in weight], "token string")
    near = N.similar_tokens(tokens.union(known.select("b")).distinct())
    rows = [(i, [list(s)], [(-weight[t], t, weight[t]) for t in set(s)]) for i, s in enumerate(spelled)]
    named = spark.createDataFrame(rows, "id long, readings array<array<string>>, ws array<struct<o double, token string, w double>>")
    got = {(r["ia"], r["ib"]) for r in N.candidates(named, N.soft_matches(tokens, near, known)).collect()}
    want = set()
    for i, a in enumerate(spelled):
        for j in range(i + 1, len(spelled)):
            sim, kind = N.compare(list(a), list(spelled[j]), weight, lambda x, y: N.token_match(x, y, nicks))
            if kind != "no" and sim >= 0.5:
                want.add((i, j))
    assert len(want) > 100
    assert not [(spelled[i], spelled[j]) for i, j in sorted(want - got)]


def test_all_quoted_nicknames_count(spark):
    # more pairs of nickname and name than any list a driver would keep, each quoted once
    rows = [([f"Name{i:05d}x “Nick{i:05d}y” Surname{i % 7}berg", f"Nick{i:05d}y Surname{i % 7}berg"], None) for i in range(40)]
    df = spark.createDataFrame(rows, "named_entities array<string>, event_label string")
    got = {r["spelling"]: r["class_id"] for r in N.link_names(df).collect()}
    assert all(got[a[0]] == got[a[1]] for a, _ in rows)


def test_token_join_of_frequent_grams_finds_what_brute_force_finds(spark):
    import random

    rnd = random.Random(5)
    words = {"verylongandx"[: rnd.choice([0, 0, 9, 10, 11, 12])] + rnd.choice("bdf") + rnd.choice(["el", "ar"]) + rnd.choice(["ab", "iz"]) + rnd.choice(["ek", "ol", "um"]) + rnd.choice(["gate", "stone", ""]) for _ in range(400)}
    for w in sorted(words):
        i = rnd.randrange(len(w) - 1)
        words |= {w[:i] + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :]} if rnd.random() < 0.5 else {w + "x"}
    assert {min(len(w), 20) for w in words} >= {6, 7, 8, 16, 17, 18, 19, 20}
    got = {(r["a"], r["b"]) for r in N.similar_tokens(spark.createDataFrame([(w,) for w in words], "token string")).collect()}
    assert got == {(a, b) for a in words for b in words if a != b and N.typing_errors(a, b) < 9}


def test_abbreviations_are_those_of_brute_force(spark):
    import random

    rnd = random.Random(6)
    words = {"".join(rnd.choice("abé") for _ in range(rnd.randint(1, 8))) for _ in range(300)} | {"a" + "b" * 70, "ab" * 40, "b" + "a" * 64}
    got = [(r["a"], r["b"]) for r in N.abbreviations(spark.createDataFrame([(w,) for w in words], "token string")).collect()]
    assert sorted(got) == sorted((a, b) for a in words for b in words if N._short_for(a, b))


def test_chance_abbreviations_bring_no_names_together(spark):
    # Each surname holds the letters of "grain" in order, which many organisations have: pairs would grow with the square.
    names = [f"{g} G{a}r{b}agi{c}nden" for i, (a, b, c) in enumerate((a, b, c) for a in "aeo" for b in "aou" for c in "bdkmpt") for g in [("Oskar", "Lena")[i % 2]]]
    firms = [f"{a}od{b}{c}mann Grain {('Board', 'Union')[i % 2]}" for i, (a, b, c) in enumerate((a, b, c) for a in "BVT" for b in "aeo" for c in "bdkmpt")]
    seen = []
    whole = N.candidates

    def counted(*args):
        seen.append(N.written(whole(*args)))
        return seen[0]

    N.candidates = counted
    try:
        got = classes(spark, [(names + firms, None)])
    finally:
        N.candidates = whole
    named = set(names)
    assert not [c for c in got if c & named and c - named]
    assert seen[0].count() < len(names) * len(firms) / 4
