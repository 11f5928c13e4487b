"""Residue and bodies of stories."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark import schemas
from quillspark.llm import mainbody as M
from quillspark.llm.residue import find_residue

URL = "https://www.paper.example/news/politics-"
STORY = "Bakers defended the bridge on Monday. Officials in the town were surprised by the vote.\nThe bill covers roofs and pipes. Growers did not agree with the plan at all."


def residue(spark, rows):
    df = spark.createDataFrame([(f"s{i}", f"st{i}", URL + str(i), t, x) for i, (t, x) in enumerate(rows)], "snapshot_id string, story_id string, canonical_url string, title string, article_text string")
    df = df.withColumns({"host": F.lit(1), "low": F.lit("x"), "marks": F.lit(2), "t": F.lit(3), "residue": F.lit(4)})
    got = {r["snapshot_id"]: r["residue"] for r in find_residue(df.unionByName(df)).collect()}
    return [got[f"s{i}"] for i in range(len(rows))]


@pytest.mark.parametrize(
    ("title", "text", "want"),
    [
        ("Bridge vote", STORY, False),
        ("Bridge vote", STORY + "\nTickets cost {{ price }} and doors open late.", True),
        ("Bridge vote", STORY + "\nTickets cost %(price)s today.", True),
        ("Bridge vote", STORY + "\nstory.author.name.label was there.", True),
        ("Bridge vote", STORY + "\nThe shop printed labels marked “${price}” before anybody noticed.", False),
        ("Coders’ corner: the little ${price} that cost a shop dear", STORY + "\nThe shop printed labels marked “${price}”.", False),
        ("How {{ title }} won", STORY, True),
        ("HEADLINE GOES HERE", STORY, True),
        ("undefined", STORY, True),
        ("Test article", STORY, True),
        ("Bridge vote", "Lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor.", True),
        ("Why designers love it", STORY + "\nThe phrase “lorem ipsum dolor sit amet” is old, designers say of it in many books.", False),
        ("Bridge vote", "xxxxx xxxxx xxxxx xxxxx xxxxx xxxxx xxxxx xxxxx xxxxx", True),
        ("Just a moment...", "Checking your browser before you enter the site.", True),
        ("Bridge vote", "404\nThe page you were looking for could not be found. Reference: a1b2c3d4", True),
        ("Bridge vote", STORY + "\nSome features of this page need JavaScript.", False),
        ("Bank told customers to enable JavaScript", STORY + "\nFor 3 hours customers met the line “Please enable JavaScript” instead.", False),
        ("Bridge vote", STORY * 5 + "\nBody text goes here.", True),
        ("Bridge vote", STORY * 5 + "\nThe page said the body text goes here, which nobody noticed until the evening.", False),
        ("Bridge vote", "\n".join(["The page you were looking for could not be found.", "Please enable JavaScript to go on.", "Access denied"] * 8), True),
        ("Bridge vote", "\n".join(["The page you were looking for could not be found.", "Please enable JavaScript to go on."] * 12 + [STORY]), False),
        ("Runners", "Exactly 404 runners crossed the line; nobody was found to have taken the short cut.", False),
        ("", "", False),
        (None, None, False),
    ],
)
def test_residue(spark, title, text, want):
    assert residue(spark, [(title, text), ("Other story", STORY)])[0] is want


def test_duplicated_responses_without_a_notice_need_a_mismatch(spark):
    odd = "Zone 7 is resting.\n" + "Come along when the lights are green again. " * 15
    rows = [(f"Harbour vote {i}", odd.replace("7", str(i))) for i in range(3)] + [("Zone lights resting green", odd), ("Bridge vote", STORY)]
    assert residue(spark, rows) == [True, True, True, False, False]
    assert residue(spark, [rows[0], rows[3], rows[4]]) == [False] * 3  # served for two stories only


def test_residue_empty(spark):
    assert find_residue(spark.createDataFrame([], schemas.ARTICLE_SNAPSHOTS)).count() == 0


def test_blocks_of_broken_pages():
    page = "<html><body><div id='x1' class='k'><p>One &amp; <b>two</b> <p>Three<br>Four<script>no()</script><!-- no --></div><ul><li>Five<li><i>Six</i></ul>tail"
    assert [b[0] for b in M.page_blocks(page)] == ["One & two", "Three", "Four", "Five", "Six", "tail"]
    assert M.page_blocks("") == []
    assert M.page_blocks("<p><b>whole</b></p>")[0][2] == "b"


def test_simple_tree_matching():
    a = M._tree(M.page_blocks("<body><div><p>Menu</p><p>x</p></div><p>Foot 1</p></body>"))
    b = M._tree(M.page_blocks("<body><div><p>Menu</p></div><p>Foot 2</p></body>"))
    assert M.simple_tree_matching(a, a) > M.simple_tree_matching(a, b)
    common = M.page_blocks("<body><nav><p>Menu</p><p>Sport 3</p></nav><main><p>one story</p><p>Advertisement</p></main><p>Foot 1</p></body>")
    rare = M.page_blocks("<body><aside>Also here</aside><nav><p>Menu</p><p>Sport 4</p></nav><section>Box</section><main><p>two story</p><p>more</p><p>Advertisement</p></main><p>Foot 2</p></body>")
    known = [M.node_key(slot, text) for text, slot, _ in common if text != "one story"]
    found = M.matched_template(rare, common, known)
    assert {t for t, slot, _ in rare if M.node_key(slot, t) in found} == {"Menu", "Sport 4", "Advertisement", "Foot 2"}
    assert not M.matched_template(rare, common, [])


def test_rare_layouts_are_aligned_with_the_commonest(spark):
    page = lambda body, extra="": M.json.dumps(M.page_blocks(f"<body>{extra}<nav><p>Menu</p></nav><main><p>{body}</p><p>Advertisement</p></main></body>"))
    rows = [(f"s{i}", "h", 1, page(f"text {'abcdefgh'[i]}")) for i in range(5)] + [("r", "h", 2, page("rare", "<div>new</div>")), ("o", "other", 1, page("x")), ("n", "h", None, None)]
    both = spark.createDataFrame(rows, "snapshot_id string, host string, layout long, blocks string")
    nodes = F.udf(lambda b: [M.node_key(s, t) for t, s, _ in M.json.loads(b)], "array<long>")
    constant = M.constant_of_layouts(both.where("blocks is not null").select("host", "layout", F.xxhash64("snapshot_id").alias("story"), nodes("blocks").alias("nodes")))
    got = {r["snapshot_id"]: r["constant"] for r in M.with_templates(both, constant).collect()}
    assert len(got) == len(rows) and got["n"] is None and got["o"] is None
    left = lambda i: [t for t, s, _ in M.json.loads(rows[i][3]) if M.node_key(s, t) not in set(got[rows[i][0]])]
    assert left(0) == ["text a"] and left(5) == ["new", "rare"]


PLACES = [a + b for a in ("Home", "News", "Sport", "Travel", "Weather", "Food", "Law", "Art") for b in ("", " North", " South", " East", " West")]


def _snapshots(spark, n=240):
    rnd = random.Random(3)
    words = "harbour budget bridge council river market school valley ferry light winter train".split()
    line = lambda: " ".join(rnd.choices(words, k=8)).capitalize() + "."
    rows, raw, want = [], [], {}
    for i in range(n):
        body, title = [line() for _ in range(5)], f"How {rnd.choice(words)} number {i} won"
        nav = rnd.sample(PLACES, 3)
        text = [*(rnd.sample(PLACES, 3) if i % 2 else []), title, *body, *(["Share this page", f"Listen to the {rnd.choice(words)} podcast"] if i % 3 else [])]
        page = f"<html><body><ul>{''.join(f'<li><a>{x}</a></li>' for x in nav)}</ul><main><h1>{title}</h1>{''.join(f'<p class=c>{b}</p>' for b in body)}<p><b>Back to top</b></p></main><div><p>Copyright 2020 The Paper</p></div></body></html>"
        rows.append((f"s{i}", URL + str(i), title, "\n".join(text), True))
        if i % 3:
            raw.append((f"s{i}", page))
        want[f"s{i}"] = {M.block_key(b) for b in body}
    s = spark.createDataFrame(rows, "snapshot_id string, canonical_url string, title string, article_text string, fetch_ok boolean")
    return s, spark.createDataFrame(raw, "snapshot_id string, article_html string"), want


def test_story_blocks(spark):
    s, raw, want = _snapshots(spark)
    s = s.withColumns({"page": F.lit(1), "text": F.lit(2), "host": F.lit("h"), "block_key": F.lit(0)})
    out = M.story_blocks(s.unionByName(s), raw.unionByName(raw), s.where("snapshot_id = 's1'")).collect()
    assert len({(r["snapshot_id"], r["block_key"]) for r in out}) == len(out)
    got = {}
    for r in out:
        got.setdefault(r["snapshot_id"], set()).add(r["block_key"])
    assert "s1" not in got
    want.pop("s1")
    right = sum(len(got.get(k, set()) & v) for k, v in want.items())
    assert right >= 0.9 * sum(map(len, want.values()))
    assert right >= 0.9 * sum(map(len, got.values()))


def test_story_blocks_nulls_and_empty(spark):
    s = spark.createDataFrame([("a", None, None, None, True), ("b", URL, "t", "", True), (None, URL, "t", "x", True), ("c", URL, "t", "x", None)], "snapshot_id string, canonical_url string, title string, article_text string, fetch_ok boolean")
    raw = spark.createDataFrame([("a", None), ("b", ""), (None, "<p>x</p>")], "snapshot_id string, article_html string")
    assert M.story_blocks(s, raw).count() == 0
    assert M.story_blocks(spark.createDataFrame([], schemas.ARTICLE_SNAPSHOTS), spark.createDataFrame([], schemas.RAW_ARTICLE_SNAPSHOTS)).count() == 0


def test_template_of_all_pages_and_wrappers_of_many_hosts(spark):
    s, raw, want = _snapshots(spark)
    hosts = F.concat(F.lit("https://h"), F.expr("int(substring(snapshot_id, 2)) % 8"), F.lit(".example/news/"), "snapshot_id")
    s = s.withColumn("canonical_url", hosts)
    # A line that stays the same stands among the paragraphs of the page and in the saved text.
    line = "Sign up for letters from our editors."
    s = s.withColumn("article_text", F.concat("article_text", F.lit("\n" + line)))
    raw = raw.withColumn("article_html", F.replace("article_html", F.lit("<p><b>Back"), F.lit(f"<p class=c>{line}</p><p><b>Back")))
    paged = {r["snapshot_id"] for r in raw.collect()}
    got = {}
    for r in M.story_blocks(s, raw, pairs=40, least=15).where(F.col("snapshot_id").isin(*paged)).collect():
        got.setdefault(r["snapshot_id"], set()).add(r["block_key"])
    assert not any(M.block_key(line) in v for v in got.values())
    right = sum(len(got.get(k, set()) & want[k]) for k in paged)
    assert right >= 0.95 * sum(len(want[k]) for k in paged)
    pages = s.join(raw, "snapshot_id").select("snapshot_id", F.regexp_extract("canonical_url", r"//([^/]+)", 1).alias("host"), "title", F.col("article_text").alias("text"), "article_html")
    read = F.udf(lambda p: M.json.dumps(M.page_blocks(p)))
    own = M.host_wrappers(pages.withColumns({"blocks": read("article_html"), "constant": F.array().cast("array<long>")}), 40, 15)
    assert own.count() == 8  # 20 pages each, of which a sample of 40 of all has about 5
