"""The story's own body on pages that mix it with other parts.

Wrapper induction, per host. Pages are read into blocks, each with its slot: the path of tags to it, without values that
differ from build to build. Pages of a host and layout have their parts in the same slots, so all of them are aligned by
slot; nodes whose text stays the same in most of their stories are template. A page of a layout that too few stories have is
aligned with a page of the host's commonest layout by simple tree matching, and what is matched with a template node of
the same text is template too. Slots that vary can hold the story or lists of other stories, so a second alignment tells
them apart: the saved text of a snapshot is another rendering of the same story, with other furniture. What a varying slot
holds is content as far as it stands in both. From a bounded sample of a host's aligned pairs two models are fitted, one for
blocks of pages and one for lines of text where no page was kept; both are logistic regressions over hashed features.

Every page is read once into blocks; every snapshot is then read whole, over blocks joined with texts by snapshot.
"""

from __future__ import annotations

import hashlib
import html
import json
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import ship_package, written

BLOCK_TAGS = frozenset(
    "html body head title address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table caption tbody td tfoot th thead tr ul br noscript button option select".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = re.compile(r"<!--.*?-->|<(script|style|template|svg)\b.*?</\1\s*>|<!\w[^>]*>", re.S | re.I)
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
ATTR = re.compile(r"\b(id|data-[\w-]+|role|itemprop|rel)\s*=\s*[\"']?([^\"'>\s]*)")
_DIGITS = re.compile(r"\d+")
_CAPITAL = re.compile(r"\b[A-Z][\w'’-]*(?: [A-Z][\w'’-]*)*")
_STOPS = frozenset(".!?”’…)\"")
BITS = 18


def tidy(text: str) -> str:
    return " ".join((html.unescape(text) if "&" in text else text).split())


def block_key(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:16]


@lru_cache(maxsize=8_192)
def _step(tag: str, attrs: str) -> str:
    """A tag's part of a slot: its name and what tells it apart, without values that differ from build to build."""
    if not attrs:
        return tag
    return tag + ("." if "class" in attrs else "") + "".join(f"[{a}={_DIGITS.sub('9', v)}]" for a, v in ATTR.findall(attrs) if a != "rel")


def page_blocks(page: str) -> list[tuple[str, str, str]]:
    """``(text, slot, wrap)`` of each block that has text: its path, and the inline tags that hold all of it.

    A block is what stands between two block-level or line-break tags. Unclosed and crossing tags are closed by their parents.
    """
    page = SILENT.sub(" ", page)
    out: list[tuple[str, str, str]] = []
    stack: list[tuple[str, str]] = []
    inline: list[str] = []
    parts: list[str] = []
    common: set[str] | None = None

    def flush() -> None:
        nonlocal common
        if parts:
            text = tidy("".join(parts))
            if text:
                out.append((text, stack[-1][1] if stack else "", "+".join(sorted(common)) if common else ""))
            parts.clear()
        common = None

    at = 0
    for m in TAG.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            if not piece.isspace():
                common = set(inline) if common is None else common & set(inline)
        at = m.end()
        tag = m[2].lower()
        if tag in BLOCK_TAGS:
            flush()
            if m[1]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
                inline.clear()
            elif tag not in VOID_TAGS and not m[3].endswith("/"):
                if tag in ("p", "li") and stack and stack[-1][0] == tag:
                    stack.pop()
                name = _step(tag, m[3])
                stack.append((tag, f"{stack[-1][1]}/{name}" if stack else name))
        elif tag not in VOID_TAGS:
            if not m[1]:
                inline.append(tag)
            elif tag in inline:
                inline.reverse()
                inline.remove(tag)
                inline.reverse()
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def text_lines(text: str) -> list[str]:
    return [t for t in (tidy_line(x) for x in text.split("\n")) if t]


def tidy_line(line: str) -> str:
    """A line of saved text; tags and entities in it are text of the story."""
    return " ".join(line.split())


def _tree(blocks: list[tuple[str, str, str]]) -> tuple:
    """The tree of slots: (name, text, children); leaves have a text and their slot."""
    root: tuple = ("", "", [])
    for text, slot, _ in blocks:
        node = root
        for name in slot.split("/"):
            if not node[2] or node[2][-1][0] != name or node[2][-1][1]:
                node[2].append((name, "", []))
            node = node[2][-1]
        node[2].append(("#", text, [], slot))
    return root


def simple_tree_matching(a: tuple, b: tuple, pairs: list[tuple[tuple, tuple]] | None = None) -> int:
    """Size of the largest top-down, order-keeping matching of two trees of equal names. ``pairs`` gets the matched nodes."""
    if a[0] != b[0]:
        return 0
    n, m = len(a[2]), len(b[2])
    w = [[simple_tree_matching(x, y) if x[0] == y[0] else 0 for y in b[2]] for x in a[2]] if n and m else []
    best = np.zeros((n + 1, m + 1), int)
    for i in range(n):
        for j in range(m):
            best[i + 1, j + 1] = max(best[i, j + 1], best[i + 1, j], best[i, j] + w[i][j])
    if pairs is not None:
        pairs.append((a, b))
        i, j = n, m
        while i and j:
            if w[i - 1][j - 1] and best[i, j] == best[i - 1, j - 1] + w[i - 1][j - 1]:
                simple_tree_matching(a[2][i - 1], b[2][j - 1], pairs)
                i, j = i - 1, j - 1
            elif best[i, j] == best[i - 1, j]:
                i -= 1
            else:
                j -= 1
    return int(best[n, m]) + 1


@lru_cache(maxsize=8_192)
def template_of(text: str) -> str:
    return _DIGITS.sub("9", text)


def matched_template(blocks: list, reference: list, constant: Iterable[int]) -> set[int]:
    """Nodes of a page that a page of another layout, aligned with it, has as template nodes of the same text (numbers alike)."""
    known, pairs = set(constant), []
    simple_tree_matching(_tree(reference), _tree(blocks), pairs)
    return {node_key(y[3], y[1]) for x, y in pairs if x[0] == "#" and template_of(x[1]) == template_of(y[1]) and node_key(x[3], x[1]) in known}


@lru_cache(maxsize=8_192)
def is_headline(slot: str) -> bool:
    """A first-level heading or the page's title, which are no body whatever stands in the text."""
    return any(t.split(".", 1)[0].split("[", 1)[0] in ("h1", "title") for t in slot.split("/"))


def _h(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature) & ((1 << BITS) - 1)


@lru_cache(maxsize=8_192)
def _shape(template: str) -> str:
    """Words with a capital made alike: names differ from page to page, what stands around them doesn't."""
    return _CAPITAL.sub("C", template[:120])[:60]


@lru_cache(maxsize=8_192)
def _of_slot(slot: str, wrap: str) -> tuple[int, ...]:
    return _h("bias"), _h(f"s|{slot}|{wrap}"), _h(f"w|{wrap}"), _h(f"l|{slot.rsplit('/', 1)[-1]}|{wrap}")


@lru_cache(maxsize=8_192)
def _of_block(text: str) -> tuple[int, ...]:
    t, words = template_of(text), text.split(" ", 2)
    return _h(f"t|{t}"), _h(f"h|{_shape(t)}"), _h(f"1|{words[0].lower()}"), _h(f"2|{' '.join(words[:2]).lower()}"), _h(f"e|{text[-1]}|{min(len(text) // 30, 5)}")


def block_features(blocks: list[tuple[str, str, str]], title: str) -> list[list[int]]:
    is_title = (_h("title"),)
    return [[*_of_slot(slot, wrap), *_of_block(text), _h(f"st|{slot}|{wrap}|{template_of(text)[:40]}"), *(is_title if text == title else ())] for text, slot, wrap in blocks]


@lru_cache(maxsize=8_192)
def _of_line(line: str) -> tuple[int, ...]:
    h = xxhash.xxh32_intdigest
    first = [w.lower() for w in line.split(" ", 3)[:3]]
    t = template_of(line)
    return h(f"t|{t}"), h(f"h|{_shape(t)}"), h(f"1|{first[0]}"), h(f"2|{' '.join(first[:2])}"), h(f"3|{' '.join(first)}"), h(f"9|{line.rsplit(' ', 1)[-1].lower()}"), h(f"e|{line[-1]}|{min(line.count(' ') // 4, 6)}|{' | ' in line or ' > ' in line}")


_SAME = {(end, same): xxhash.xxh32_intdigest(f"n|{end}|{same}") for end in (True, False) for same in ("title", "part", "no")}


def line_features(lines: list[str], title: str) -> np.ndarray:
    """A row of feature numbers per line: its own, its place's, and those of two lines on either side."""
    small, last, own = title.casefold(), -1, []
    for i, line in enumerate(lines):
        low = line.casefold()
        if low == small:
            last = i
        same = "title" if low == small else "part" if len(low) > 12 and (low in small or small in low) and small else "no"
        own.append((*_of_line(line), _SAME[line[-1] in _STOPS, same]))
    own = np.array(own, np.uint32)
    n = len(lines)
    at = np.arange(n)
    place = np.stack([np.full(n, 11), 1000 + np.minimum(at, 4), 2000 + np.minimum(n - 1 - at, 6), 3000 + (at < last) + 2 * (last >= 0)], axis=1).astype(np.uint32)
    padded = np.full((n + 4, 8), 77, np.uint32)
    padded[2 : n + 2] = own
    near = [padded[2 + d : 2 + d + n][:, [0, 1, 3, 6, 7]] * np.uint32(2654435761) + np.uint32(40503 * (d + 9)) for d in (-2, -1, 1, 2)]
    x = np.concatenate([place * np.uint32(2246822519), own, *near], axis=1)
    return ((x >> np.uint32(13)) ^ x) & np.uint32((1 << BITS) - 1)


def second_features(scores: np.ndarray, lines: list[str]) -> np.ndarray:
    """A line's score with those of its neighbours and of its doc's ends; dense."""
    n = len(scores)
    pad = np.concatenate([np.zeros(4), scores, np.zeros(4)])
    cols = [pad[4 + d : 4 + d + n] for d in range(-4, 5)]
    up = np.cumsum(scores) / np.arange(1, n + 1)
    down = (np.cumsum(scores[::-1]) / np.arange(1, n + 1))[::-1]
    before = np.concatenate([[0.0], np.maximum.accumulate(scores)[:-1]])
    after = np.concatenate([np.maximum.accumulate(scores[::-1])[::-1][1:], [0.0]])
    stop = np.array([x[-1] in _STOPS for x in lines], float)
    return np.stack([*cols, up, down, before, after, np.minimum(pad[3 : 3 + n], pad[5 : 5 + n]), np.maximum(pad[3 : 3 + n], pad[5 : 5 + n]), stop, stop * scores, np.ones(n)], axis=1)


def fit_hashed(rows: list[list[int]], y: np.ndarray, epochs: int = 6, rate: float = 0.3, decay: float = 1e-6) -> np.ndarray:
    """Logistic regression over sparse binary features, by batches with per-weight steps. Deterministic."""
    w, g2 = np.zeros(1 << BITS), np.full(1 << BITS, 1e-8)
    flat = np.concatenate([np.asarray(r) for r in rows]) if rows else np.zeros(0, int)
    size = np.array([len(r) for r in rows])
    start = np.concatenate([[0], np.cumsum(size)])
    rng = np.random.default_rng(5)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 256):
            b = order[at : at + 256]
            ix = np.concatenate([flat[start[i] : start[i + 1]] for i in b])
            who = np.repeat(np.arange(len(b)), size[b])
            z = np.bincount(who, weights=w[ix], minlength=len(b))
            err = y[b] - 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            u, inv = np.unique(ix, return_inverse=True)
            g = np.bincount(inv, weights=err[who]) - decay * w[u]
            g2[u] += g * g
            w[u] += rate * g / np.sqrt(g2[u])
    return w.astype(np.float32)


def fit_dense(x: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton's method."""
    mean, std = x.mean(axis=0), x.std(axis=0) + 1e-9
    mean[-1], std[-1] = 0.0, 1.0
    z = (x - mean) / std
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-3 * len(z) / 100 * np.eye(len(w)), z.T @ (y - p) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w, mean, std


def scores_of(rows: list[list[int]] | np.ndarray, w: np.ndarray) -> np.ndarray:
    if isinstance(rows, np.ndarray):
        return w[rows].sum(axis=1)
    if not rows:
        return np.zeros(0)
    size = np.array([len(r) for r in rows])
    return np.add.reduceat(w[np.concatenate(rows)], np.r_[0, np.cumsum(size)[:-1]])


@lru_cache(maxsize=8_192)
def node_key(slot: str, text: str) -> int:
    """A text (numbers alike) in its slot, as a signed 64-bit number."""
    return xxhash.xxh64_intdigest(f"{slot}|{template_of(text)}") - 2**63


def varying(blocks: list, constant: Iterable[int] | None) -> list:
    """The blocks that aren't template."""
    if constant is None or not len(constant):
        return blocks
    known = set(constant)
    return [b for b in blocks if node_key(b[1], b[0]) not in known]


class Wrapper:
    """The two models of a host's pages."""

    def __init__(self, blocks: np.ndarray, lines: np.ndarray, second: tuple):
        self.blocks, self.lines, self.second = blocks, lines, second

    def of_page(self, blocks: list, constant: Iterable[int] | None, text: str, title: str) -> list[str]:
        """Body blocks in order, without template. The page and the text must both hold a block, unless they have nothing in common."""
        both = set(text_lines(text))
        aligned = [b for b in blocks if b[0] in both]
        few = varying(aligned or blocks, constant)
        z = scores_of(block_features(few, title), self.blocks)
        return [b[0] for b, s in zip(few, z, strict=True) if s > (-1.0 if aligned else 0.0) and not is_headline(b[1])]

    def of_text(self, text: str, title: str) -> list[str]:
        lines = text_lines(text)
        if not lines:
            return []
        z = scores_of(line_features(lines, title), self.lines)
        w, mean, std = self.second
        z = ((second_features(np.clip(z, -8, 8), lines) - mean) / std) @ w
        return [x for x, s in zip(lines, z, strict=True) if s > 0]


def layout(blocks: list[tuple[str, str, str]]) -> str:
    """The order of the parts right below the body."""
    tops = [s.split("/")[2] if s.count("/") >= 2 else s for _, s, _ in blocks if "body" in s]
    return "|".join(k for k, p in zip(tops, [None, *tops], strict=False) if k != p)


def induce(pages: pd.DataFrame) -> Wrapper:
    """Fits a wrapper to aligned pairs (``blocks, constant, text, title``)."""
    read = [(varying(json.loads(b), c), text_lines(t), tidy(ti)) for b, c, t, ti in zip(pages["blocks"], pages["constant"], pages["text"], pages["title"], strict=True)]
    rows, y = [], []
    for b, lines, title in read:
        both = set(lines)
        if any(x[0] in both for x in b):
            rows += block_features(b, title)
            y += [float(x[0] in both and not is_headline(x[1])) for x in b]
    w = fit_hashed(rows, np.array(y)) if rows else np.zeros(1 << BITS, np.float32)
    half: list[list] = [[], []]
    for k, (b, lines, title) in enumerate(read):
        both = set(lines)
        z = scores_of(block_features(b, title), w)
        body = {x[0] for x, s in zip(b, z, strict=True) if x[0] in both and s > -1.0 and not is_headline(x[1])}
        if body:
            half[k % 2].append((line_features(lines, title), np.array([float(x in body) for x in lines]), lines))
    if not half[0] or not half[1]:
        return Wrapper(w, np.zeros(1 << BITS, np.float32), (np.zeros(18), np.zeros(18), np.ones(18)))
    # The second model sees scores as they are for unseen texts: those of each half by the other half's weights.
    parts = [fit_hashed([list(f) for d in h for f in d[0]], np.concatenate([d[1] for d in h])) for h in half]
    x2 = np.concatenate([second_features(np.clip(scores_of(f, parts[1 - k]), -8, 8), lines) for k in (0, 1) for f, _, lines in half[k]])
    y2 = np.concatenate([d[1] for k in (0, 1) for d in half[k]])
    return Wrapper(w, (parts[0] + parts[1]) / 2, fit_dense(x2, y2))


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        read = [page_blocks(p) for p in b["page"]]
        yield pd.DataFrame({
            "snapshot_id": b["snapshot_id"],
            "layout": [xxhash.xxh64_intdigest(layout(r)) - 2**63 for r in read],
            "nodes": [list({node_key(slot, text) for text, slot, _ in r}) for r in read],
            "blocks": [json.dumps(r, ensure_ascii=False) for r in read],
        })


def constant_of_layouts(pages: DataFrame) -> DataFrame:
    """``host, layout, stories, constant``: the nodes in more than half of the stories, of at least three, of a host's layout, from all its pages (``host, layout, story, nodes``)."""
    stories = pages.groupBy("host", "layout", "story").agg(F.array_distinct(F.flatten(F.collect_list("nodes"))).alias("nodes"))
    stories = written(stories)
    totals = stories.groupBy("host", "layout").agg(F.count("*").alias("stories")).where("stories > 2")
    counts = stories.select("host", "layout", F.explode("nodes").alias("node")).groupBy("host", "layout", "node").agg(F.count("*").alias("n")).where("n > 1")
    return counts.join(totals, ["host", "layout"]).where("n * 2 > stories").groupBy("host", "layout").agg(F.max("stories").alias("stories"), F.collect_list("node").alias("constant"))


def _matched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        found = [list(matched_template(json.loads(x), json.loads(r), c)) for x, r, c in zip(b["blocks"], b["reference"], b["known"], strict=True)]
        yield pd.DataFrame({"host": b["host"], "layout": b["layout"], "found": found})


def with_templates(both: DataFrame, constant: DataFrame) -> DataFrame:
    """``both`` (``snapshot_id, host, layout, blocks`` and more) with ``constant``: the template nodes of each page's layout, null where its host has none.

    Those of a layout without any of its own are what its pages, which are of two stories at most, have in common with a page of the host's commonest one.
    """
    pages = both.where("blocks is not null").select("snapshot_id", "host", "layout", "blocks")
    top = constant.groupBy("host").agg(F.max(F.struct("stories", "layout", F.col("constant").alias("known"))).alias("m")).select("host", "m.layout", "m.known")
    first = pages.select("host", "layout", "snapshot_id").join(top, ["host", "layout"]).groupBy("host", "layout").agg(F.min("snapshot_id").alias("snapshot_id"), F.first("known").alias("known"))
    reference = pages.join(first, ["snapshot_id", "host", "layout"]).groupBy("host").agg(F.min("blocks").alias("reference"), F.first("known").alias("known"))
    rare = pages.select("host", "layout").distinct().join(constant.select("host", "layout"), ["host", "layout"], "left_anti")
    aligned = pages.join(rare, ["host", "layout"]).join(reference, "host").select("host", "layout", "blocks", "reference", "known")
    found = aligned.mapInPandas(_matched, "host string, layout long, found array<long>").groupBy("host", "layout").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("constant"))
    every = written(constant.select("host", "layout", "constant").unionByName(found))
    return both.join(every, ["host", "layout"], "left")


def _bodies(b: pd.DataFrame, w: Wrapper) -> pd.DataFrame:
    ids, keys, texts, places = [], [], [], []
    for sid, title, text, blocks, constant in zip(b["snapshot_id"], b["title"], b["text"], b["blocks"], b["constant"], strict=True):
        title = tidy(title)
        body = w.of_page(json.loads(blocks), constant, text, title) if blocks else w.of_text(text, title)
        body = list(dict.fromkeys(body))
        ids += [sid] * len(body)
        keys += [block_key(x) for x in body]
        texts += body
        places += range(len(body))
    return pd.DataFrame({"snapshot_id": ids, "block_key": keys, "place": places, "block": texts}, dtype=None if ids else object)


def _extract(shared) -> callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(body := _bodies(b, shared.value)):
                yield body

    return run


def sample_pairs(pages: DataFrame, pairs: int) -> pd.DataFrame:
    """About ``pairs`` snapshots with a page, of all hosts, by the hash of their id; only they travel."""
    total = pages.count()
    limit = min(2**63 - 1, -(2**63) + int(min(1.0, pairs / max(total, 1)) * 2**64))
    few = pages.where(F.xxhash64("snapshot_id") <= limit).select("snapshot_id", "host", "title", "text", "blocks", "constant")
    return few.dropDuplicates(["snapshot_id"]).orderBy(F.xxhash64("snapshot_id"), "snapshot_id").limit(2 * pairs).toPandas()


def host_wrappers(pages: DataFrame, pairs: int, least: int) -> DataFrame | None:
    """``host, wrapper``: packed wrappers of all hosts with at least ``least`` snapshots with a page, each fitted on an executor to about ``pairs`` of them. None where all pages are of one host, which the shared wrapper is fitted to."""
    ids = pages.select("host", "snapshot_id").distinct()
    sizes = written(ids.groupBy("host").agg(F.count("*").alias("of_host")))
    own = sizes.where(F.col("of_host") >= least)
    if len(sizes.take(2)) < 2 or not own.take(1):
        return None
    some = pages.join(own, "host").where(F.pmod(F.xxhash64("snapshot_id"), F.lit(2**40)) / F.lit(float(2**40)) * F.col("of_host") < pairs)
    some = some.select("host", "snapshot_id", "title", "text", "blocks", "constant").dropDuplicates(["snapshot_id"])

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        w = induce(rows.sort_values("snapshot_id", ignore_index=True))
        return pd.DataFrame({"host": rows["host"].iloc[:1], "wrapper": [zlib.compress(pickle.dumps(w), 1)]})

    return written(some.groupBy("host").applyInPandas(fit, "host string, wrapper binary"))


def story_blocks(snapshots: DataFrame, raw: DataFrame, excluded: DataFrame | None = None, pairs: int = 2000, least: int = 200) -> DataFrame:
    """``snapshot_id, block_key, place, block``: the blocks of the story's own body, each text once per snapshot.

    All snapshots with ``fetch_ok`` that aren't in ``excluded`` (snapshot_id). Where there is a page with text it is read
    together with the saved text, else the text alone. Repeated rows count once; rows of one snapshot_id that differ all
    count, a block comes out at its first place. A null text or title is empty; a snapshot without text and page has no
    block, one without id doesn't come out. An empty table gives no rows. Extra columns are ignored.

    What is template is counted over all pages of a host and layout. The models of a host are fitted to about ``pairs`` of
    its snapshots, however many hosts there are; hosts with fewer than ``least`` snapshots with a page share one wrapper,
    fitted to about ``pairs`` of all (the bound of what the driver sees).
    """
    spark = snapshots.sparkSession
    ship_package(spark)
    host = F.coalesce(F.regexp_extract("canonical_url", r"^\w+://([^/]+)", 1), F.lit(""))
    s = snapshots.where("fetch_ok and snapshot_id is not null").select("snapshot_id", host.alias("host"), F.xxhash64(F.coalesce("canonical_url", "snapshot_id")).alias("story"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("article_text", F.lit("")).alias("text"))
    p = raw.where("snapshot_id is not null and article_html <> ''").select("snapshot_id", F.col("article_html").alias("page"))
    if excluded is not None:
        s = s.join(excluded.select("snapshot_id").distinct(), "snapshot_id", "left_anti")
    read = p.mapInPandas(_parsed, "snapshot_id string, layout long, nodes array<long>, blocks string")
    both = written(s.join(read, "snapshot_id", "left"))
    paired = both.where("blocks is not null")
    constant = written(constant_of_layouts(paired.select("host", "layout", "story", "nodes")))
    both = with_templates(both.drop("nodes", "story"), constant)
    paired = both.where("blocks is not null")
    shared = spark.sparkContext.broadcast(induce(sample_pairs(paired, pairs)))
    own = host_wrappers(paired, pairs, least)
    schema = "snapshot_id string, block_key string, place int, block string"
    columns = ["snapshot_id", "title", "text", "blocks", "constant"]
    rest = both if own is None else both.join(own.select("host"), "host", "left_anti")
    out = rest.select(columns).mapInPandas(_extract(shared), schema)
    if own is not None:
        parts = both.join(own.select("host"), "host", "left_semi").withColumn("part", F.pmod(F.xxhash64("snapshot_id"), F.lit(2**31)))
        # A task of a host holds about 1,000 snapshots and its wrapper.
        size = parts.groupBy("host").agg(F.ceil(F.count("*") / F.lit(1000)).alias("k"))
        parts = parts.join(size, "host").withColumn("part", F.pmod("part", "k")).select("host", "part", *columns)
        each = size.join(own, "host").select("host", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("part"), "wrapper").toDF("of_host", "of_part", "wrapper")
        each = written(each)  # with columns of its own

        def by_host(rows: pd.DataFrame, wrapper: pd.DataFrame) -> pd.DataFrame:
            return _bodies(rows, pickle.loads(zlib.decompress(wrapper["wrapper"].iloc[0])))

        out = out.unionByName(parts.groupBy("host", "part").cogroup(each.groupBy("of_host", "of_part")).applyInPandas(by_host, schema))
    w = out.groupBy("snapshot_id", "block_key").agg(F.min(F.struct("place", "block")).alias("x"))
    return w.select("snapshot_id", "block_key", "x.place", "x.block")
