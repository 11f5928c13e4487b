"""Sentences, packing and mixing."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.llm import mixing, packing
from quillspark.llm import sentences as S
from quillspark.llm.tokens import load, TOKENIZER

DOCS = "doc_id long, text string, source string"


def corpus(n=600):
    rnd = random.Random(7)
    who, what = ["Dr. Smith", "The council", "Mr. Jones", "Growers", "iGrow"], ["the bridge", "a row over e.g. parking", "the budget", "the U.S. arm", "pipes, wiring, etc."]
    en = lambda: rnd.choice([f"{rnd.choice(who)} defended {rnd.choice(what)} on Monday.", "“We are not closing,” said Mr. Brown.", "“Hurry! It is late!” shouted Mr. Brown.", f"Prices rose by {rnd.randint(1, 9)}.{rnd.randint(1, 9)} per cent.", "Really?!"])
    zh = lambda: rnd.choice(["费用上涨了40.7%。", "图书馆称：“够了！没有人问过我们。”", "“没有人问过我们。”农民协会的发言人说。", "真没想到！"])
    out = []
    for i in range(n):
        make, glue = (zh, "") if i % 5 == 0 else (en, " ")
        out.append("\n\n".join(glue.join(make() for _ in range(rnd.randint(1, 4))) for _ in range(3)))
    return out


@pytest.fixture(scope="module")
def model(spark):
    return S.fit(spark.createDataFrame([(i, t, "s") for i, t in enumerate(corpus())], DOCS))


def parts(text, model):
    return [text[a:b] for a, b in S.split(text, model)]


def test_sentences(model):
    text = "Dr. Smith defended the bridge on Monday. “Hurry! It is late!” shouted Mr. Brown. Prices rose by 3.4 per cent.\n\nMr. Jones defended a row over e.g. parking on Monday. Really?!"
    assert parts(text, model) == ["Dr. Smith defended the bridge on Monday.", "“Hurry! It is late!” shouted Mr. Brown.", "Prices rose by 3.4 per cent.", "Mr. Jones defended a row over e.g. parking on Monday.", "Really?!"]
    assert parts("图书馆称：“够了！没有人问过我们。”“没有人问过我们。”农民协会的发言人说。真没想到！", model) == ["图书馆称：“够了！没有人问过我们。”", "“没有人问过我们。”农民协会的发言人说。", "真没想到！"]


def test_rare_contexts_count_in_coarser_ones(spark, model):
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(corpus())], DOCS)
    few = S.fit(docs, finest=5)
    assert sum(k[0] == 4 for k in few.after) == 5 < sum(k[0] == 4 for k in model.after)
    coarse = lambda m: {k for k in m.before if k[0] < 4}
    assert coarse(few) == coarse(model)
    assert parts("Mr. Jones defended the budget on Monday. Really?! Growers defended the bridge on Monday.", few) == ["Mr. Jones defended the budget on Monday.", "Really?!", "Growers defended the bridge on Monday."]


def test_headings_lists_times_and_wraps(model):
    assert parts("Key dates\n\n• one thing\n• another\n  thing\n\n18:37 Growers defended the budget. It rained", model) == ["Key dates", "• one thing", "• another\n  thing", "18:37 Growers defended the budget. It rained"]
    assert parts("The council defended\nthe bridge on Monday.", model) == ["The council defended\nthe bridge on Monday."]


def test_every_character_is_in_one_sentence(model):
    rnd = random.Random(1)
    for text in [*corpus(40), "", "  \n ", "....", "“", "a" * 30_000, "x. " * 9_000, "".join(rnd.choice("ab. \n“”\"'()!?。ก ") for _ in range(3_000))]:
        at = 0
        for a, b in S.split(text, model):
            assert a >= at and b > a
            assert not text[at:a].strip()
            assert not text[a].isspace() and not text[b - 1].isspace()
            at = b
        assert not text[at:].strip()


def test_sentences_of_tables(spark, model):
    rows = [(1, "One. Two.", "s"), (1, "One. Two.", "s"), (2, None, "s"), (3, "", "s"), (None, "x", "s")]
    df = spark.createDataFrame(rows, DOCS).withColumns({"place": F.lit(1), "sentence": F.lit("x")})
    assert {r["doc_id"] for r in S.sentences(df, model).collect()} == {1}
    assert S.sentences(spark.createDataFrame([], DOCS)).count() == 0


def _count(text):
    return len(load(TOKENIZER).encode(text, add_special_tokens=False).ids)


def test_queue_keeps_shares_and_capacity():
    rnd = random.Random(2)
    items = [(i, rnd.choice("aaab"), rnd.randint(1, 60)) for i in range(3000)]
    total = sum(x[2] for x in items)
    shares = {s: sum(x[2] for x in items if x[1] == s) / total for s in "ab"}
    boxes, credit = packing.pack_queue(items, 200, shares)
    assert sorted(i for b in boxes for i in b) == list(range(3000))
    sizes = [sum(items[i][2] for i in b) for b in boxes]
    assert max(sizes) <= 200 and sum(sizes) / (200 * len(sizes)) > 0.98
    seen = {s: 0 for s in "ab"}
    for k, b in enumerate(boxes[:-20], 1):
        for i in b:
            seen[items[i][1]] += items[i][2]
        assert abs(seen["a"] / sum(seen.values()) - shares["a"]) < 0.02 + 2 / k
    assert abs(sum(credit.values())) < 200 * 20


def test_pack_tables(spark):
    rnd = random.Random(5)
    docs = [(i, " ".join(rnd.choices(["harbour", "budget", "x", "flooding"], k=rnd.choice([0, 1, 5, 30, 200]))), rnd.choice(["hot", "hot", "b", None])) for i in range(400)]
    df = spark.createDataFrame([*docs, docs[3], (900, None, "b"), (None, "x", "b")], DOCS).withColumns({"tokens": F.lit("t"), "piece": F.lit(0), "capacity": F.lit(1)})
    plans = spark.createDataFrame([("p", 100), ("p", 100), ("q", 40), (None, 10), ("bad", 0)], "plan_name string, capacity_tokens int")
    for part_tokens in (10**9, 900):
        out = packing.pack(df, plans, part_tokens=part_tokens).toPandas()
        for plan, capacity in (("p", 100), ("q", 40)):
            rows = out[out.plan_name == plan]
            assert rows.groupby("container").tokens.sum().max() <= capacity
            assert rows.groupby("container").tokens.sum().mean() > 0.93 * capacity
            for doc, g in rows.groupby("doc_id"):
                size = _count(dict((d[0], d[1]) for d in docs)[doc])
                g = g.sort_values("token_start")
                assert g.tokens.sum() == size and g.token_start.tolist() == [0, *g.tokens.cumsum().tolist()[:-1]]
                assert len(g) == 1 or size > capacity
            assert set(rows.doc_id) == {d[0] for d in docs if d[1]}
    assert packing.fill_report(packing.pack(df, plans), plans).count() == 2
    assert packing.pack(spark.createDataFrame([], DOCS), plans).count() == 0
    assert packing.pack(df, plans.where("false")).count() == 0


def test_items_that_never_fit_stay_in_their_buckets(spark):
    text = "harbour " * 60
    df = spark.createDataFrame([(i, text, "ab"[i % 2]) for i in range(600)], DOCS)
    size = _count(text)
    plans = spark.createDataFrame([("p", size + size // 2)], "plan_name string, capacity_tokens int")
    out = packing.pack(df, plans, part_tokens=size * 20).toPandas()
    assert sorted(out.doc_id) == list(range(600)) and out.container.nunique() == 600
    levels = out.container.str.extract(r"^(\d+)-(\d+)-")
    assert (levels.groupby([0, 1]).size() <= 45).all()


def test_packing_to_target_shares(spark):
    rnd = random.Random(9)
    df = spark.createDataFrame([(i, " ".join(rnd.choices(["harbour", "budget", "x"], k=rnd.randint(1, 12))), "ab"[i % 2]) for i in range(2000)], DOCS)
    plans = spark.createDataFrame([("p", 100)], "plan_name string, capacity_tokens int")
    targets = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("gone", 0.0), (None, None)], "source string, target_share double")
    out = packing.pack(df, plans, targets).toPandas()
    out["k"] = out.container.str.rsplit("-", n=1).str[1].astype(int)
    first = out[out.k < out.k.max() // 2].groupby("source").tokens.sum()
    assert abs(first["a"] / first.sum() - 0.75) < 0.02  # as long as a lasts
    assert out.tokens.sum() == sum(_count(r["text"]) for r in df.collect())


def test_mix(spark):
    rnd = random.Random(6)
    docs = [(i, " ".join(rnd.choices(["harbour", "budget", "x"], k=rnd.randint(1, 60))), "hot" if i % 3 == 0 else rnd.choice("abc")) for i in range(1500)]
    df = spark.createDataFrame([*docs, docs[0], (9999, None, "a"), (9998, "x", None)], DOCS).withColumns({"copies": F.lit(1), "place": F.lit(2), "c": F.lit(3)})
    targets = spark.createDataFrame([("m", "hot", 0.2, 3), ("m", "a", 0.5, 3), ("m", "b", 0.1, 2), ("m", "gone", 0.2, 2), ("m", None, 0.1, 2), ("m", "c", 0.0, 2), ("m", "a", 0.5, 3)], "mix_name string, source string, target_share double, max_repeats int")
    sel = mixing.select_mix(df, targets).toPandas()
    limit = {"hot": 3, "a": 3, "b": 2}
    assert set(sel.source) == set(limit) and not sel.duplicated(["mix_name", "doc_id"]).any()
    assert all(g.copies.max() <= limit[s] and g.copies.max() - (g.copies.min() if len(g) == sum(d[2] == s for d in docs) else 0) <= 1 for s, g in sel.groupby("source"))
    rep = mixing.share_report(df, targets).toPandas().set_index("source")
    assert rep.loc["gone", "tokens"] == 0
    for s, share in (("hot", 0.25), ("a", 0.625), ("b", 0.125)):
        assert abs(rep.loc[s, "reached_share"] - share) < 0.01
        assert rep.loc[s, "tokens"] == (sel[sel.source == s].tokens * sel[sel.source == s].copies).sum()
    # Another partitioning gives the same selection.
    again = mixing.select_mix(df.repartition(7), targets).toPandas()
    key = ["mix_name", "source", "doc_id", "copies"]
    assert sorted(map(tuple, sel[key].values)) == sorted(map(tuple, again[key].values))
    assert mixing.select_mix(spark.createDataFrame([], DOCS), targets).count() == 0
    assert mixing.select_mix(df, targets.where("false")).count() == 0


def test_places_without_a_sort_of_the_source(spark):
    df = spark.createDataFrame([(i, "s", 1 + i % 3) for i in range(500)], "doc_id long, source string, tokens long")
    got = sorted((r["place"], r["tokens"]) for r in mixing.places(df, cell=20).collect())
    assert [p for p, _ in got] == list(range(1, 501))
    assert [t for _, t in got] == sorted(t for _, t in got)
