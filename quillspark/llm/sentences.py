"""Sentence boundaries in texts of any language and script, by a hidden-event n-gram language model.

A paragraph is read into tokens; a quotation or bracket that closes is one token that shows how it ends. Between two
tokens that could be parted stands a hidden event: a boundary or none. The model is of n-grams over
tokens and boundaries: how likely a boundary is after the tokens before it, how likely before the two tokens after it, and
how likely at all. Each backs off to shorter and coarser contexts. Nothing is labelled: paragraphs begin and
end with a sentence for certain, which shows what stands at boundaries and how often; expectation-maximisation fills in the
rest over all documents. Posteriors come from the forward-backward recursion over the events of a paragraph, as an
event is part of the context of the next.

Thai has no marks between sentences; there every blank can be a boundary. Chinese and Japanese are read by pairs of
characters. The same model serves all languages, so passages in a second language need nothing of their own.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import ship_package, written

TERMINAL = frozenset(".!?…。！？．।॥؟۔")
WIDE_TERMINAL = frozenset("。！？")
PAIRS = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "【": "】", "《": "》", "‘": "’"}
_OPENING = re.compile("[" + re.escape("".join(PAIRS)) + "\"']")
CLOSERS = frozenset("”’»›」』）)]】》\"'“")
BRACKETS = frozenset("（([【")
_BLANK = re.compile(r"\n[^\S\n]*\n\s*")
_THAI = "฀-๿"
_WIDE = "぀-ヿ㐀-䶿一-鿿ｦ-ﾟ"
_TOKEN = re.compile(
    rf"(?P<thai>[{_THAI}]+\.?)|(?P<wide>[{_WIDE}ー々]{{1,2}})|(?P<dots>\.{{2,}}|…+)|(?P<word>(?:[^\W_{_THAI}{_WIDE}]{{1,3}}\.){{2,}}(?![^\W_])|[^\W_{_THAI}{_WIDE}]+(?:['’\-][^\W_{_THAI}{_WIDE}]+)*\.(?![^\W_A-ZÀ-Þ])|[^\W_{_THAI}{_WIDE}]+(?:[ऀ-ॿؐ-ٟ̀-ͯ]+[^\W_{_THAI}{_WIDE}]*)*(?:[.,:/@?=\-'’_&]+[^\W_{_THAI}{_WIDE}]+)*\.?)|(?P<mark>[.!?…。！？．।॥؟۔]+|[^\w\s]|_)"
)
_MARK = re.compile(r"\s*(?:([•‣◦▪·*–\-])|(\(?)(\d{1,3}|[a-z])([.)])|(\d{1,2}[:.]\d{2}))(?=\s+\S)")


def paragraphs(text: str) -> list[tuple[int, int]]:
    """Spans between blank lines, without outer white space."""
    out, at = [], 0
    for m in [*_BLANK.finditer(text), None]:
        a, b = at, m.start() if m else len(text)
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b))
        at = m.end() if m else b
    return out


def list_items(text: str, a: int, b: int) -> list[tuple[int, int, bool]]:
    """A paragraph's items, if its first line begins with a mark: each line with such a mark begins one. ``(start, end, is_item)``."""

    def kind(at: int, end: int) -> tuple | None:
        m = _MARK.match(text, at, end)
        if not m:
            return None
        if m[1]:
            return ("bullet", m[1])
        if m[5]:
            rest = text[m.end() : end].lstrip()
            return ("time", "") if rest and not rest[0].islower() and not rest[0].isdigit() else None
        return ("number" if m[3].isdigit() else "letter", m[2] + m[4])

    first = kind(a, b)
    if first is None or (first[0] == "letter" and "\n" not in text[a:b]):
        return [(a, b, False)]
    starts, at, number = [a], a, None
    if first[0] == "number":
        number = int(_MARK.match(text, a, b)[3])
        if "\n" not in text[a:b] and not first[1].startswith("(") and first[1] != ")" and text[a:b].count(".") > 2:
            return [(a, b, False)]
    while (at := text.find("\n", at, b)) >= 0:
        at += 1
        if kind(at, b) == first:
            if number is not None:
                n = int(_MARK.match(text, at, b)[3])
                if n != number + 1:
                    continue
                number = n
            starts.append(at)
    out = []
    for s, e in zip(starts, [*starts[1:], b], strict=True):
        while s < e and text[s].isspace():
            s += 1
        while e > s and text[e - 1].isspace():
            e -= 1
        out.append((s, e, True))
    return out


def enclosed(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Outermost quotations and brackets that close within a paragraph."""
    out, at = [], a
    while (m := _OPENING.search(text, at, b)) is not None:
        at = m.start()
        c = text[at]
        before = text[at - 1] if at > a else " "
        after = text[at + 1] if at + 1 < b else " "
        end = -1
        if c in PAIRS and not (c == "‘" and before.isalnum()):
            depth = 0
            for k in range(at + 1, b):
                x = text[k]
                if x in PAIRS[c]:
                    if c == "‘" and k + 1 < b and text[k + 1].isalnum():
                        continue
                    if depth == 0:
                        end = k
                        break
                    depth -= 1
                elif x == c and c not in "‘":
                    depth += 1
        elif c in "\"'" and not after.isspace() and not before.isalnum():
            for k in range(at + 1, b):
                x = text[k]
                if x == c and not text[k - 1].isspace() and (k + 1 >= b or not text[k + 1].isalnum()):
                    end = k
                    break
        if end > at:
            out.append((at, end + 1))
            at = end + 1
        else:
            at += 1
    return out


class Token:
    __slots__ = ("end", "kind", "last", "start", "text")

    def __init__(self, start: int, end: int, kind: str, text: str, last: str):
        self.start, self.end, self.kind, self.text, self.last = start, end, kind, text, last


def tokens_of(text: str, a: int, b: int) -> list[Token]:
    out: list[Token] = []

    def plain(s: int, e: int) -> None:
        for m in _TOKEN.finditer(text, s, e):
            t = m[0]
            out.append(Token(*m.span(), m.lastgroup, t, t[-1]))

    at = a
    for s, e in enclosed(text, a, b):
        plain(at, s)
        inner = e - 2
        while inner > s and (text[inner].isspace() or text[inner] in CLOSERS):
            inner -= 1
        last = text[inner]
        kind = "bracket" if text[s] in BRACKETS else "quote"
        out.append(Token(s, e, kind, f"<{'P' if kind == 'bracket' else 'Q'}{last if not last.isalnum() else ''}>", last))
        at = e
    plain(at, b)
    return out


def gaps_of(text: str, toks: list[Token]) -> list[int]:
    """Positions i so that a boundary can stand between tokens i and i + 1."""
    out = []
    for i in range(len(toks) - 1):
        x, y = toks[i], toks[i + 1]
        space = y.start > x.end
        wide = x.last in WIDE_TERMINAL
        if y.kind == "mark" and y.text[0] in TERMINAL and not space:
            continue
        if y.kind == "mark" and y.text[0] in ",;:、，；：)]" and not space:
            continue
        if space and (x.kind == "thai" or y.kind == "thai"):
            out.append(i)
        elif x.last in TERMINAL or (x.kind == "mark" and x.text in CLOSERS and i and toks[i - 1].last in TERMINAL):
            if space or wide:
                out.append(i)
            elif y.kind in ("word", "quote") and (y.kind == "quote" or y.text[0].isupper()) and x.kind in ("word", "bracket", "quote", "mark", "dots"):
                glued = x.text.rstrip(".")
                if x.kind != "word" or (len(glued) > 1 and "." not in glued and not glued[0].isupper()) or glued.isdigit():
                    out.append(i)
    return out


_NUM = re.compile(r"\d+")


def plain_form(t: Token) -> str:
    if t.kind in ("quote", "bracket"):
        return t.text
    if t.kind == "thai":
        return t.text if len(t.text) <= 6 else t.text[:6]
    return _numbers_alike(t.text)


@lru_cache(maxsize=200_000)
def _numbers_alike(text: str) -> str:
    return _NUM.sub("9", text)


def coarse(form: str, kind: str) -> str:
    """What a rare token looks like."""
    if kind in ("quote", "bracket", "mark", "dots"):
        return form if len(form) < 3 or form[0] == "<" else form[:2]
    dot = "." if form.endswith(".") else ""
    body = form.rstrip(".")
    if kind == "thai":
        return "<th>"
    if kind == "wide":
        return "<w>"
    if not body or body[0].isdigit():
        return "<9" + dot + ">"
    if "." in body:
        return "<a.b" + dot + ">"
    if body[0].isupper():
        return ("<X" if len(body) == 1 else "<XX" if body.isupper() else "<Xx") + dot + ">"
    return ("<x" if body[0].islower() else "<o") + dot + ">"


def left_form(t: Token, vocabulary: set[str]) -> str:
    if t.kind == "thai" and len(t.text) > 6:
        return "~" + t.text[-5:]
    p = plain_form(t)
    return p if p in vocabulary or t.kind in ("quote", "bracket", "mark", "dots") else coarse(p, t.kind)


def right_form(t: Token, vocabulary: set[str]) -> str:
    p = plain_form(t)
    return p if p in vocabulary or t.kind in ("quote", "bracket", "mark", "dots") else coarse(p, t.kind)


def _far(left: Callable[[int], str], i: int) -> str:
    """What stands before token i, with the token before a number: ``At 9.9``."""
    if i == 0:
        return "^"
    near = left(i - 1)
    return f"{left(i - 2)} {near}" if i > 1 and near[0] == "9" else near


def events_of(text: str, a: int, b: int, vocabulary: set[str]) -> tuple[list[Token], list[tuple]]:
    """Tokens and events of a paragraph: ``(i, l2, l1, r1, r2, hangs)``. ``hangs`` tells that l2 is the start if a boundary stands at the event before."""
    toks = tokens_of(text, a, b)
    left: dict[int, str] = {}
    right: dict[int, str] = {}

    def before_gap(i: int) -> str:
        got = left.get(i)
        if got is None:
            got = left[i] = left_form(toks[i], vocabulary)
        return got

    def after_gap(i: int) -> str:
        got = right.get(i)
        if got is None:
            got = right[i] = right_form(toks[i], vocabulary)
        return got

    out, last = [], -2
    for i in gaps_of(text, toks):  # forms are made only of tokens next to a gap
        r2 = after_gap(i + 2) if i + 2 < len(toks) else "$"
        out.append((i, _far(before_gap, i), before_gap(i), after_gap(i + 1), r2, last == i - 1))
        last = i
    return toks, out


class Model:
    """The n-grams of the hidden event: a boundary after ``l2 l1``, and a boundary before ``r1 r2``, each with its backoffs."""

    def __init__(self, vocabulary: set[str], after: dict, before: dict):
        self.vocabulary, self.after, self.before = vocabulary, after, before
        self.prior = _logit(after.get(ALL, 0.5))
        self._known: dict[tuple, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": {}}

    def odds(self, l2: str, l1: str, r1: str, r2: str) -> float:
        key = (l2, l1, r1, r2)
        got = self._known.get(key)
        if got is None:
            got = _logit(_look(self.after, l2, l1)) + _logit(_look(self.before, r2, r1)) - self.prior
            if len(self._known) > 500_000:
                self._known.clear()
            self._known[key] = got
        return got


#: The coarsest context.
ALL = (0, "", "")


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def _look(table: dict, far: str, near: str) -> float:
    """The longest context that is known."""
    for key in reversed(_keys(far, near)):
        if key in table:
            return table[key]
    return 0.5


def _keys(far: str, near: str) -> tuple:
    """Contexts from the coarsest to the finest: ``(level, a, b)``."""
    return (ALL, (1, _kind_of(near), ""), (2, near, ""), (3, _kind_of(far), near), (4, far, near))


def _above(key: tuple) -> tuple | None:
    """The next coarser context."""
    level, a, b = key
    return None if level == 0 else ALL if level == 1 else (1, _kind_of(a), "") if level == 2 else (2, b, "") if level == 3 else (3, _kind_of(a), b)


@lru_cache(maxsize=200_000)
def _kind_of(form: str) -> str:
    """A coarser class of a form."""
    if form[:1] == "<" or form in ("^", "$"):
        return form
    if form[:1] == "~":
        return "<th>"
    if form[:1].isalnum():
        k = "thai" if "฀" <= form[0] <= "๿" else "wide" if re.match(f"[{_WIDE}]", form) else "word"
        return coarse(form, k)
    return form[:2]


def _group(form: str) -> str:
    k = _kind_of(form)
    return "thai" if k == "<th>" else "wide" if k == "<w>" or any(c in form for c in "。！？」』：") else "spaced"


def _table(seen: dict, edge: dict, mass: dict, weight: tuple[float, ...] = (0, 2, 8, 8, 6)) -> dict:
    """Share of events that are boundaries, by context ``(level, a, b)``: events, paragraph edges times their factor, expected boundaries.

    How often a context stands at a paragraph's edge tells how often it stands at a boundary within paragraphs, by the
    factor of its script; expected boundaries are mixed in half and half once there are some. Each context falls back on the next coarser.
    """
    out: dict = {}
    for k in sorted(seen):
        n = seen[k]
        est = min(edge.get(k, 0.0), n)
        if mass:
            est = 0.5 * est + 0.5 * mass.get(k, 0.0)
        up = _above(k)
        w = weight[k[0]]
        out[k] = min(max((est + w * (out[up] if up else 0.5)) / (n + w), 0.002), 0.998)
    return out


def _factor(near: dict[str, tuple[float, float]]) -> dict[str, float]:
    """Boundaries within paragraphs for each one at an edge, by script: that of contexts which nearly always are at one, as most are. ``near`` has events and edges of each form."""
    out = {}
    for g in ("thai", "wide", "spaced"):
        pairs = sorted((inner / max(edge, 0.5), inner) for k, (inner, edge) in near.items() if inner and _group(k) == g)
        total, at = sum(n for _, n in pairs), 0.0
        out[g] = 1.0
        for ratio, n in pairs:
            at += n
            if at >= total * (0.3 if g == "thai" else 0.5):
                out[g] = max(ratio, 0.2)
                break
    return out


def posteriors(events: list[tuple], model: Model) -> np.ndarray:
    """Probability of a boundary at each event: forward-backward over two states, as an event can be the context of the next."""
    move = []  # of a boundary, by the state before
    for _, l2, l1, r1, r2, hangs in events:
        p = _chance(model.odds(l2, l1, r1, r2))
        move.append((p, _chance(model.odds("^", l1, r1, r2)) if hangs else p))
    forward, f0, f1 = [], 1.0, 0.0
    for p0, p1 in move:
        f0, f1 = f0 * (1 - p0) + f1 * (1 - p1), f0 * p0 + f1 * p1
        f0, f1 = f0 / (f0 + f1), f1 / (f0 + f1)
        forward.append((f0, f1))
    out, b0, b1 = np.empty(len(events)), 1.0, 1.0
    for k in range(len(events) - 1, -1, -1):
        f0, f1 = forward[k]
        out[k] = f1 * b1 / (f0 * b0 + f1 * b1)
        p0, p1 = move[k]
        b0, b1 = (1 - p0) * b0 + p0 * b1, (1 - p1) * b0 + p1 * b1
        b0, b1 = b0 / (b0 + b1), b1 / (b0 + b1)
    return out


def _chance(odds: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def split(text: str, model: Model) -> list[tuple[int, int]]:
    """Sentence spans of a text, in code points; every character but white space between sentences is in exactly one."""
    out: list[tuple[int, int]] = []
    for pa, pb in paragraphs(text):
        for a, b, item in list_items(text, pa, pb):
            if item:
                out.append((a, b))
                continue
            toks, events = events_of(text, a, b, model.vocabulary)
            at = a
            for (i, *_), p in zip(events, posteriors(events, model), strict=True):
                if p >= 0.5:
                    end = toks[i].end
                    out.append((at, end))
                    at = toks[i + 1].start
            out.append((at, b))
    return out


def _count_tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        c: Counter = Counter()
        for text in b["text"]:
            for pa, pb in paragraphs(text):
                for a, e, item in list_items(text, pa, pb):
                    if not item:
                        c.update(plain_form(t) for t in tokens_of(text, a, e) if t.kind in ("word", "thai", "wide"))
        if c:
            yield pd.DataFrame({"token": list(c), "n": list(c.values())})


def _count_events(vocabulary) -> callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = vocabulary.value
        for b in batches:
            c: Counter = Counter()
            for text in b["text"]:
                for pa, pb in paragraphs(text):
                    for a, e, item in list_items(text, pa, pb):
                        if item:
                            continue
                        toks, events = events_of(text, a, e, known)
                        if not toks:
                            continue
                        c.update(("g", *x[1:5]) for x in events)
                        right = [right_form(t, known) for t in toks[:2]] + ["$"]
                        c[("s", right[0], right[1], "", "")] += 1
                        if toks[-1].last in TERMINAL or toks[-1].kind == "thai":
                            left = [left_form(t, known) for t in toks[-3:]]
                            c[("e", _far(left.__getitem__, len(left) - 1), left[-1], "", "")] += 1
            if not c:
                continue
            k = list(zip(*c, strict=True))
            yield pd.DataFrame({"kind": k[0], "x1": k[1], "x2": k[2], "x3": k[3], "x4": k[4], "n": list(c.values())})

    return run


_KEYED = "side int, level int, a string, b string, seen double, edge double"


def _by_level(factors: list[dict[str, float]]) -> callable:
    """Events and paragraph edges of each context, for it and all coarser ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen, edge = Counter(), Counter()
            for side, far, near, n, c in zip(b["side"], b["far"], b["near"], b["seen"], b["certain"], strict=True):
                c *= factors[side][_group(near)]
                for k in _keys(far, near):
                    seen[(side, *k)] += n
                    edge[(side, *k)] += c
            if seen:
                k = list(zip(*seen, strict=True))
                yield pd.DataFrame({"side": k[0], "level": k[1], "a": k[2], "b": k[3], "seen": list(seen.values()), "edge": [edge[x] for x in seen]})

    return run


def _expected(model) -> callable:
    """Expected boundaries of the contexts that the model has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        for b in batches:
            mass = Counter()
            for l2, l1, r1, r2, n in zip(b["x1"], b["x2"], b["x3"], b["x4"], b["n"], strict=True):
                p = n * _chance(m.odds(l2, l1, r1, r2))
                for side, table, far, near in ((0, m.after, l2, l1), (1, m.before, r2, r1)):
                    for k in _keys(far, near):
                        if k in table:
                            mass[(side, *k)] += p
            if mass:
                k = list(zip(*mass, strict=True))
                yield pd.DataFrame({"side": k[0], "level": k[1], "a": k[2], "b": k[3], "mass": list(mass.values())})

    return run


def _rows(df: DataFrame) -> Iterator[tuple]:
    return df.toPandas().itertuples(index=False, name=None)


def fit(documents: DataFrame, vocabulary_size: int = 4000, finest: int = 500_000, rounds: int = 4) -> Model:
    """The model over all documents, by expectation-maximisation; texts that occur more than once count once.

    Different events ``(l2, l1, r1, r2)`` stay a distributed table, and each round takes expectations over all of them. The
    driver gets tables of contexts only: those of the ``vocabulary_size`` most frequent tokens (a rarer token counts as
    its class) and classes, and of each side the ``finest`` most frequent pairs of tokens. An event of a rarer pair isn't
    left out: it counts in all coarser contexts, and is scored by them.
    """
    spark = documents.sparkSession
    ship_package(spark)
    texts = documents.where("text is not null").select("text").dropDuplicates(["text"])
    words = texts.mapInPandas(_count_tokens, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    vocabulary = {r[0] for r in words.orderBy(F.col("n").desc(), "token").limit(vocabulary_size).collect()}
    shared = spark.sparkContext.broadcast(vocabulary)
    counts = texts.mapInPandas(_count_events(shared), "kind string, x1 string, x2 string, x3 string, x4 string, n long").groupBy("kind", "x1", "x2", "x3", "x4").agg(F.sum("n").alias("n"))
    counts = written(counts)
    events = counts.where("kind = 'g'")
    inner = [events.select(F.lit(0).alias("side"), F.col("x1").alias("far"), F.col("x2").alias("near"), F.col("n").alias("seen"), F.lit(0).alias("certain")), events.select(F.lit(1), "x4", "x3", "n", F.lit(0))]
    edges = [counts.where("kind = 'e'").select(F.lit(0), "x1", "x2", F.lit(0), "n"), counts.where("kind = 's'").select(F.lit(1), "x2", "x1", F.lit(0), "n")]
    contexts = reduce(DataFrame.union, [*inner, *edges]).groupBy("side", "far", "near").agg(F.sum("seen").cast("double").alias("seen"), F.sum("certain").cast("double").alias("certain"))
    contexts = written(contexts)
    near: list[dict] = [{}, {}]
    for side, form, n, c in _rows(contexts.groupBy("side", "near").agg(F.sum("seen"), F.sum("certain"))):
        near[side][form] = (n, c)
    levels = written(contexts.mapInPandas(_by_level([_factor(x) for x in near]), _KEYED).groupBy("side", "level", "a", "b").agg(F.sum("seen").alias("seen"), F.sum("edge").alias("edge")).where("seen > 0"))
    top = [levels.where(f"level = 4 and side = {i}").orderBy(F.col("seen").desc(), "a", "b").limit(finest) for i in (0, 1)]
    seen: list[dict] = [{}, {}]
    edge: list[dict] = [{}, {}]
    for side, level, a, b, n, c in _rows(levels.where("level < 4").unionByName(top[0]).unionByName(top[1])):
        seen[side][(level, a, b)], edge[side][(level, a, b)] = n, c
    mass: list[dict] = [{}, {}]
    for done in range(rounds):
        model = Model(vocabulary, *[_table(seen[i], edge[i], mass[i]) for i in (0, 1)])
        if done < rounds - 1:
            mass = [{}, {}]
            expected = events.mapInPandas(_expected(spark.sparkContext.broadcast(model)), "side int, level int, a string, b string, mass double")
            for side, level, a, b, m in _rows(expected.groupBy("side", "level", "a", "b").agg(F.sum("mass"))):
                mass[side][(level, a, b)] = m
    return model


def sentences(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, place, sent_start, sent_end, sentence`` of every document; ``model`` is fitted to them if none is given.

    Offsets are code points from 0, the end exclusive, without outer white space. A null, empty or blank text has no
    sentence; a doc_id that occurs twice counts twice, equal rows once. Texts are read whole, however long. Extra columns
    are ignored.
    """
    spark = documents.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model or fit(documents))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            ids, places, starts, ends, texts = [], [], [], [], []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                spans = split(text, m)
                ids += [doc] * len(spans)
                places += range(len(spans))
                starts += [s for s, _ in spans]
                ends += [e for _, e in spans]
                texts += [text[s:e] for s, e in spans]
            if ids:
                yield pd.DataFrame({"doc_id": ids, "place": places, "sent_start": starts, "sent_end": ends, "sentence": texts})

    return documents.where("doc_id is not null and text is not null").select("doc_id", "text").dropDuplicates(["doc_id", "text"]).mapInPandas(run, "doc_id long, place int, sent_start int, sent_end int, sentence string")
