"""Spellings that mean the same person or organisation.

1. Spellings are read into tokens: accents and case dropped, titles, quoted nicknames, bracketed initials and small words
   left out. A hyphenated token can be read as one or as two.
2. Tokens are joined to the tokens they may be typing errors of: a set-similarity join on positional q-grams. Within k
   typing errors at most 4k trigrams change, so two such tokens share one of their 4k + 1 rarest ones (the prefix).
3. A spelling's rare tokens weigh more: a token's weight is its inverse document frequency, where an error counts as
   often as the more frequent token it may stand for. Of two spellings that mean the same, the one with fewer tokens has
   all of them matched in the other, so its heaviest written-out token alone brings candidates together: joined to all
   tokens it matches, be they equal, errors, nicknames or abbreviations. If it may match an initial, a second token must
   match too.
4. Candidates are verified token by token: equal, typing error, abbreviation, nickname or initial. Tokens left over on both
   sides mean different entities. A pair without leftovers is strong; one with an initial or a missing token is weak.
5. Strong pairs make classes. A weak pair joins two classes only if the shorter one has no other class to belong to:
   "K. Smith" is Katherine's if no other K. Smith is known.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.vectors import components
from quillspark.session import ship_package, written

TITLES = frozenset("mr mrs ms miss dr prof professor sir dame lord lady rev reverend capt captain col gen general lt maj sgt cllr councillor sen rep hon judge justice president minister".split())
SMALL = frozenset("the of and for".split())
SUFFIXES = frozenset("jr sr ii iii iv".split())
NICKNAMES = {
    "alex": "alexander alexandra", "andy": "andrew", "drew": "andrew", "angie": "angela", "annie": "anna anne", "tony": "anthony antonia", "art": "arthur", "barb": "barbara", "becky": "rebecca", "bella": "isabella", "ben": "benjamin", "beth": "elizabeth", "betty": "elizabeth", "bill": "william", "billy": "william", "bob": "robert", "bobby": "robert", "cal": "callum", "cathy": "catherine katherine", "charlie": "charles charlotte", "chuck": "charles", "chris": "christopher christine", "dan": "daniel", "danny": "daniel", "dave": "david", "debbie": "deborah", "deb": "deborah", "dick": "richard", "dora": "theodora", "dot": "dorothy", "dottie": "dorothy", "ed": "edward", "eddie": "edward", "ted": "edward theodore", "ellie": "eleanor", "fred": "frederick", "freddie": "frederick", "gill": "gillian", "greg": "gregory", "harry": "henry harold", "hetty": "henrietta", "hal": "henry", "jack": "john", "jen": "jennifer", "jenny": "jennifer", "jess": "jessica", "jill": "gillian", "jim": "james", "jimmy": "james", "joe": "joseph", "johnny": "john", "jon": "jonathan", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "ken": "kenneth", "kim": "kimberly", "kit": "christopher", "larry": "lawrence", "liz": "elizabeth", "lizzie": "elizabeth", "lou": "louis louise", "maggie": "margaret", "matt": "matthew", "meg": "margaret", "mick": "michael", "mike": "michael", "nat": "nathan natalie", "nick": "nicholas", "pam": "pamela", "pat": "patricia patrick", "patty": "patricia", "peggy": "margaret", "pete": "peter", "phil": "philip", "ray": "raymond", "rick": "richard", "rob": "robert", "ron": "ronald", "sally": "sarah", "sam": "samuel samantha", "sandy": "alexander sandra", "steve": "stephen steven", "sue": "susan", "susie": "susan", "teddy": "edward theodore", "terry": "terence theresa", "tess": "theresa tessa", "theo": "theodore theodora", "tim": "timothy", "tom": "thomas", "tommy": "thomas", "trish": "patricia", "vicky": "victoria", "vic": "victor victoria", "walt": "walter", "will": "william", "zoe": "zofia",
}
_KEYS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
_AT = {c: (r, i + r * 0.5) for r, row in enumerate(_KEYS) for i, c in enumerate(row)}


@lru_cache(maxsize=4096)
def beside(a: str, b: str) -> bool:
    """Whether two letters are neighbours on a keyboard."""
    if a not in _AT or b not in _AT:
        return False
    (r, x), (s, y) = _AT[a], _AT[b]
    return abs(r - s) <= 1 and abs(x - y) <= 1.0


def allowed(length: int) -> int:
    """Typing errors that a token of this length may have."""
    return 0 if length < 3 else 1 if length < 7 else 2


@lru_cache(maxsize=200_000)
def typing_errors(a: str, b: str) -> int:
    """Letters left out, put in, swapped with the next, or hit beside the right key, at least; 9 if there are more than allowed."""
    limit = allowed(min(len(a), len(b)))
    if a == b:
        return 0
    if abs(len(a) - len(b)) > limit:
        return 9
    if len(a) == len(b):
        differ = [i for i in range(len(a)) if a[i] != b[i]]
        if len(differ) == 1 and not beside(a[differ[0]], b[differ[0]]):
            return 9  # another letter, not a slip of the finger
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            c = min(row[j] + 1, new[-1] + 1, row[j - 1] + (0 if x == y else 1 if beside(x, y) else 3))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                c = min(c, before[j - 2] + 1)
            new.append(c)
        if min(new) > limit:
            return 9
        before, row = row, new
    return row[-1] if row[-1] <= limit else 9


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()


def read(spelling: str) -> tuple[list[list[str]], str | None]:
    """The token lists a spelling can be read as (two if a hyphen can be left out), and the nickname quoted in it with its name, as ``nick name``."""
    nick = None
    text = re.sub(r"\([^()]*\)", " ", spelling)
    quoted = re.search(r"(\w+)\s+[“\"‘]([^”\"’]+)[”\"’]", text)
    if quoted:
        nick = f"{fold(quoted[2])} {fold(quoted[1])}"
        text = text.replace(quoted[0], quoted[1])
    text = fold(text)

    def tokens(t: str) -> list[str]:
        t = re.sub(r"['’]s\b", "s", t)
        found = re.findall(r"[^\W_]+", t.replace("'", "").replace("’", ""))
        kept = [x for x in found if x not in SMALL and x not in SUFFIXES]
        while len(kept) > 1 and kept[0] in TITLES:
            kept = kept[1:]
        return kept or found

    first = tokens(text)
    joined = tokens(re.sub(r"(?<=\w)-(?=\w)", "", text))
    return [first] if joined == first else [first, joined], nick


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        got = [read(s) for s in b["spelling"]]
        lower = [[t for t in re.findall(r"[^\W_]+", s) if t[:1].islower()] if not s.isupper() else [] for s in b["spelling"]]
        yield b.assign(readings=[g[0] for g in got], nick=[g[1] for g in got], lower=[[fold(x) for x in t] for t in lower], upper=[s.isupper() for s in b["spelling"]])


def spellings(signals: DataFrame) -> DataFrame:
    """``spelling, n``: elements of named_entities and what leads event_label before its first colon, without outer blanks; null and blank ones are none."""
    blank = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    named = signals.select(F.explode("named_entities").alias("s"))
    led = signals.select(F.substring_index("event_label", ":", 1).alias("s"))
    return named.unionByName(led).groupBy("s").agg(F.count("*").alias("n")).select(blank("s").alias("spelling"), "n").where("spelling <> ''").groupBy("spelling").agg(F.sum("n").alias("n"))


def _left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each token with what stays of it without up to as many letters as it may have errors."""
    for b in batches:
        token, rest = [], []
        for t in b.column("token").to_pylist():
            n = range(len(t))
            some = {t} | {t[:i] + t[i + 1 :] for i in n}
            if allowed(len(t)) > 1:
                some |= {t[:i] + t[i + 1 : j] + t[j + 1 :] for j in n for i in range(j)}
            token += [t] * len(some)
            rest += some
        for i in range(0, len(token), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(token[i : i + 100_000], pa.string()), pa.array(rest[i : i + 100_000], pa.string())], ["token", "rest"])


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of tokens with an equal ``key``, verified, of a partition sorted by it; some more than once."""
    key, token = np.empty(0, np.int64), np.empty(0, object)

    def met(key: np.ndarray, token: np.ndarray) -> pa.RecordBatch:
        near = set()
        at = np.arange(len(key))
        d = 1
        while len(at := at[at < len(key) - d]) and len(at := at[key[at] == key[at + d]]):
            for a, b in zip(token[at], token[at + d], strict=True):
                if a != b and typing_errors(*(pair := (a, b) if a < b else (b, a))) < 9:
                    near.add(pair)
            d += 1
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in near], pa.string()) for i in (0, 1)], ["a", "b"])

    for b in batches:
        if not len(b):
            continue
        key = np.concatenate([key, b.column("key").to_numpy()])
        token = np.concatenate([token, b.column("token").to_numpy(zero_copy_only=False)])
        whole = np.searchsorted(key, key[-1])  # the last key may go on in the next batch
        if whole:
            yield met(key[:whole], token[:whole])
            key, token = key[whole:], token[whole:]
    if len(key):
        yield met(key, token)


def similar_tokens(tokens: DataFrame, q: int = 3, hot: int = 20) -> DataFrame:
    """``a, b``: different tokens that may be typing errors of each other, both ways round; ``tokens`` has distinct ``token``.

    A gram in the prefixes of more than ``hot`` tokens brings no tokens of up to 18 letters together, as their pairs would grow with the square. Those that have
    such a gram meet instead at what stays of them: within k errors, leaving out up to k letters of each makes two tokens equal.
    """
    parts = tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")
    pad = "\x01" * (q - 1)
    t = tokens.where(F.length("token") >= 3).select("token", F.length("token").alias("len"), F.concat(F.lit(pad), F.col("token"), F.lit(pad)).alias("p"))
    grams = t.select("token", "len", F.posexplode(F.expr(f"transform(sequence(1, length(p) - {q - 1}), i -> substring(p, i, {q}))")).alias("pos", "gram"))
    df = grams.groupBy("gram").agg(F.count("*").alias("df"))
    ranked = grams.join(df, "gram").groupBy("token", "len").agg(F.array_sort(F.collect_list(F.struct("df", "gram", "pos"))).alias("g"))
    errors = F.when(F.col("len") < 7, 1).otherwise(2)
    ranked = written(ranked.select("token", "len", F.slice("g", F.lit(1), errors * (q + 1) + 1).alias("g")))
    # The last of a prefix is its most frequent. With a token of 19 letters or more, one of 17 or more can be near.
    prefix = ranked.select("token", "len", F.explode("g").alias("x")).where((F.col("x.df") <= hot) | (F.col("len") > 16)).select("token", "len", "x.gram", "x.pos")
    a, b = prefix.select("gram", F.col("token").alias("a"), F.col("len").alias("la"), F.col("pos").alias("pa")), prefix.select("gram", F.col("token").alias("b"), F.col("len").alias("lb"), F.col("pos").alias("pb"))
    near = (F.col("a") < F.col("b")) & (F.abs(F.col("la") - F.col("lb")) <= 2) & (F.abs(F.col("pa") - F.col("pb")) <= 2)
    pairs = a.join(b, "gram").where(near).select("a", "b").distinct().where(F.levenshtein("a", "b") <= 4)

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield x[[typing_errors(p, r) < 9 for p, r in zip(x["a"], x["b"], strict=True)]]

    left = ranked.where((F.element_at("g", -1)["df"] > hot) & (F.col("len") <= 18)).select("token").repartition(int(parts)).mapInArrow(_left_out, "token string, rest string").select(F.xxhash64("rest").alias("key"), "token")
    met = left.repartition(int(parts), "key").sortWithinPartitions("key").mapInArrow(_meeting, "a string, b string")
    found = written(pairs.mapInPandas(verified, "a string, b string").unionByName(met).distinct())
    return found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _short_for(a: str, b: str) -> bool:
    """Whether ``a`` abbreviates ``b``: the same first letter, and its letters in order."""
    if not 2 <= len(a) < len(b) or a[0] != b[0]:
        return False
    rest = iter(b)
    return all(c in rest for c in a)


def token_match(a: str, b: str, nicks: dict[str, set[str]]) -> tuple[float, bool]:
    """How well two tokens agree (0 to 1) and whether that is sure by itself."""
    if a == b:
        return 1.0, len(a) > 1
    if typing_errors(a, b) < 9:
        return 0.95, True
    if b in nicks.get(a, ()) or a in nicks.get(b, ()):
        return 0.95, True
    if any(typing_errors(b, x) < 9 for x in nicks.get(a, ())) or any(typing_errors(a, x) < 9 for x in nicks.get(b, ())):
        return 0.9, True
    short, whole = (a, b) if len(a) < len(b) else (b, a)
    if len(short) == 1:
        return (0.8, False) if whole[0] == short else (0.0, False)
    if _short_for(short, whole):
        return (0.9, len(short) > 2) if len(short) > 2 or not whole.startswith(short) else (0.85, False)
    return 0.0, False


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows for each token: as one that may abbreviate (``side`` 0) with its first two letters, as one that may be abbreviated (1) with
    its first and each later letter. Bits of ``letters`` and ``order`` stand for its letters and for pairs of a letter and a later one; what
    abbreviates a token has no other bits. Of tokens above 64 letters only the letters count."""

    def bits(t: str) -> tuple[int, int]:
        seen: dict[str, int] = {}
        letters = order = 0
        for c in t:
            n = seen[c] = seen.get(c, -1) + 1
            letters |= 1 << (ord(c) + 26 * min(n, 1)) % 63
        if len(t) <= 64:
            code = [ord(c) for c in t]
            for i, c in enumerate(code):
                for d in code[i + 1 :]:
                    order |= 1 << (c * 29 + d * 7) % 63
        return letters, order

    schema = pa.schema([("key", pa.string()), ("side", pa.int8()), ("token", pa.string()), ("letters", pa.int64()), ("order", pa.int64())])
    for b in batches:
        rows = []
        for t in b.column("token").to_pylist():
            letters, order = bits(t)
            rows.append((t[:2], 0, t, letters, order))
            if len(t) > 2:
                rows += [(t[0] + y, 1, t, letters, order if len(t) <= 64 else 2**63 - 1) for y in set(t[1:])]
        for i in range(0, len(rows), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 100_000], strict=True), schema, strict=True)], schema=schema)


def _abbreviated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``a, b`` as ``_short_for`` has it, of a partition sorted by ``key, side``."""
    at, short, letters, order = None, [], None, None
    for batch in batches:
        out: tuple[list[str], list[str]] = ([], [])
        columns = (batch.column(c) for c in ("key", "side", "token"))
        for key, side, token, l, o in zip(*(c.to_pylist() for c in columns), batch.column("letters").to_numpy(), batch.column("order").to_numpy(), strict=True):
            if key != at:
                at, short, bits, letters = key, [], [], None
            if not side:
                short.append(token)
                bits.append((l, o))
                continue
            if not short:
                continue
            if letters is None:
                letters, order = np.array(bits, np.int64).T.copy()
            some = np.flatnonzero(letters & ~l == 0)
            for i in some[order[some] & ~o == 0].tolist():
                if _short_for(short[i], token):
                    out[0].append(short[i])
                    out[1].append(token)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], ["a", "b"])


def abbreviations(tokens: DataFrame) -> DataFrame:
    """``a, b``: tokens ``a`` that abbreviate tokens ``b``, as ``_short_for`` has it. Both have the same first letter, and b has a's second one and all others."""
    parts = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    signed = tokens.where(F.length("token") > 1).repartition(parts).mapInArrow(_signed, "key string, side byte, token string, letters long, order long")
    return signed.repartition(parts, "key").sortWithinPartitions("key", "side").mapInArrow(_abbreviated, "a string, b string")


def soft_matches(tokens: DataFrame, near: DataFrame, known: DataFrame) -> DataFrame:
    """``a, b``, both ways round: all tokens that ``token_match`` gives a score, but for those of an initial and a longer token."""
    same = tokens.select(F.col("token").alias("a"), F.col("token").alias("b"))
    named = known.select(F.col("token").alias("a"), "b")
    mistyped = named.select("a", F.col("b").alias("x")).join(near.select(F.col("a").alias("x"), "b"), "x").select("a", "b")
    one_way = named.unionByName(mistyped).unionByName(abbreviations(tokens))
    both = one_way.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.a", "x.b")
    return written(same.unionByName(near).unionByName(both).distinct())


def candidates(named: DataFrame, soft: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``ia, ib``: all pairs of spellings that ``compare`` may accept at ``threshold``; ``named`` has ``id, readings, ws``.

    Of an accepted pair one side has all its tokens matched, so the heaviest written-out token of the one with fewer tokens
    has a match in the other. If it is a written-out one, that alone is no key, as words of many names abbreviate surnames by chance.

    * If the heaviest token of the longer is matched too, both matches are the key.
    * If not, a written-out token is left over, so they share an equal token, which is the second part of the key; and
      a token that alone has most of the weight can't be the one left over, as the similarity would be under the threshold.

    Where the match is an initial, either the other is all initials, or a second token of
    the shorter matches a written-out one: a written-out one too, or else, with all of those matching initials, an initial; and only initials are
    left over. One of initials alone has them all among the other's first letters.
    """
    r = named.select("id", "ws", F.explode("readings").alias("r")).where(F.size("r") > 0).withColumn("long", F.filter("r", lambda t: F.length(t) > 1))
    r = r.withColumn("bare", F.size("long") == 0).withColumn("from", F.when(F.col("bare"), F.col("r")).otherwise(F.col("long")))
    top = F.array_max(F.transform(F.filter("ws", lambda x: F.array_contains("from", x["token"])), lambda x: F.struct(x["w"].alias("w"), x["token"].alias("token"))))
    weights = F.map_from_arrays(F.transform("ws", lambda x: x["token"]), F.transform("ws", lambda x: x["w"]))
    square = F.aggregate("r", F.lit(0.0), lambda s, t: s + F.pow(F.coalesce(F.try_element_at("weights", t), F.lit(1.0)), F.lit(2.0)))
    place = F.struct(F.size("r").alias("size"), F.col("bare"), F.col("id"))
    r = r.withColumn("weights", weights).withColumn("top", top).withColumn("leads", F.pow("top.w", F.lit(2.0)) > square * F.lit(1 - threshold**2) + F.lit(1e-6))
    r = written(r.select("id", "r", "long", "bare", "leads", F.col("top.token").alias("top"), place.alias("place")))
    left = r.select(F.col("id").alias("ia"), F.col("place").alias("pa"), F.col("top").alias("a"), "long", "bare", F.array_distinct("r").alias("own"), F.substring("top", 1, 1).alias("letter"))
    single = F.filter(F.array_distinct("r"), lambda t: F.length(t) == 1)
    right = r.select(F.col("id").alias("ib"), F.col("place").alias("pb"), F.explode(F.array_distinct("r")).alias("b"), "bare", single.alias("initials"), (F.size("r") - F.size("long")).alias("singles"))
    more = F.col("pb.size") - F.col("pa.size")  # tokens left over

    met = left.where("not bare").drop("bare").join(soft, "a").select("ia", "pa", F.col("b").alias("u"), "own")
    keyed = met.select("ia", "pa", "u", F.explode("own").alias("v"))
    other = r.where("not bare").select(F.col("id").alias("ib"), F.col("place").alias("pb"), F.col("top").alias("a"), F.array_distinct("r").alias("own"), "leads", (F.size("r") - F.size("long")).alias("singles"))
    by_soft = other.join(soft, "a").select("ib", "pb", "own", "singles", F.col("b").alias("v"), F.lit(True).alias("sure"))
    by_initial = other.select("ib", "pb", "own", "singles", F.substring("a", 1, 1).alias("v"), F.lit(False).alias("sure"))
    tops = by_soft.unionByName(by_initial).select("ib", "pb", "singles", "v", "sure", F.explode("own").alias("u"))
    found = keyed.join(tops, ["u", "v"]).where("pa < pb").where(F.col("sure") | (more <= F.col("singles"))).select("ia", "ib")
    rest = other.where("not leads").select("ib", "pb", F.array_except("own", F.array("a")).alias("own"))
    few = rest.where(F.size("own") <= 30)  # pairs of more tokens would be too many rows
    equal = keyed.join(few.select("ib", "pb", "own", F.explode("own").alias("u")).select("ib", "pb", "u", F.explode("own").alias("v")), ["u", "v"]).where("pa < pb").select("ia", "ib")
    many = met.drop("own").join(rest.where(F.size("own") > 30).select("ib", "pb", F.explode("own").alias("u")), "u").where("pa < pb").select("ia", "ib")

    bare = left.where("length(a) > 1").drop("bare").join(right.where("bare").withColumn("letter", F.col("b")), "letter").where("pa < pb").select("ia", "ib")
    second = left.select("ia", "pa", "letter", F.explode(F.array_except("long", F.array("a"))).alias("a"))
    initialed = right.where("length(b) > 1").select("ib", "pb", "b", "singles", F.explode("initials").alias("letter"))
    # The words of many names are among the second tokens, so it is the others that are joined to what they match.
    third = initialed.join(soft, "b").join(second, ["a", "letter"]).where("pa < pb").where(more < F.col("singles")).select("ia", "ib")
    first = lambda t: F.substring(t, 1, 1)
    crossed = r.where("not bare").select(F.col("id").alias("ia"), F.col("place").alias("pa"), first("top").alias("letter"), F.transform("long", first).alias("firsts"), F.explode(single).alias("z"))
    whole = right.where("length(b) > 1").select("ib", "pb", first("b").alias("z"), "initials", "singles", F.explode("initials").alias("letter")).distinct()
    fourth = crossed.join(whole, ["letter", "z"]).where("pa < pb").where(more < F.col("singles")).where(F.size(F.array_except("firsts", "initials")) == 0).select("ia", "ib")
    letters = r.where("bare").select(F.col("id").alias("ia"), F.col("place").alias("pa"), F.col("r").alias("own"), F.col("top").alias("z"))
    starts = r.select(F.col("id").alias("ib"), F.col("place").alias("pb"), F.array_distinct(F.transform("r", first)).alias("firsts"))
    fifth = letters.join(starts.withColumn("z", F.explode("firsts")), "z").where("pa < pb").where(F.size(F.array_except("own", "firsts")) == 0).select("ia", "ib")
    every = found.unionByName(equal).unionByName(many).unionByName(bare).unionByName(third).unionByName(fourth).unionByName(fifth).where("ia <> ib")
    return every.select(F.least("ia", "ib").alias("ia"), F.greatest("ia", "ib").alias("ib")).distinct()


def compare(a: list[str], b: list[str], weight: dict[str, float], match: Callable[[str, str], tuple[float, bool]]) -> tuple[float, str]:
    """Soft cosine and kind of a pair of token lists: ``strong``, ``weak`` (an initial or a missing token) or ``no``."""
    dot, sure, key, exact_key = 0.0, True, -1.0, False
    options = sorted(((m, i, j) for i, x in enumerate(a) for j, y in enumerate(b) if (m := match(x, y))[0]), key=lambda o: (-o[0][0], -weight.get(a[o[1]], 1.0), o[1], o[2]))
    used_a, used_b = set(), set()
    initials: list[tuple[list[str], set[int], int]] = []
    for (score, certain), i, j in options:
        if i in used_a or j in used_b:
            continue
        used_a.add(i)
        used_b.add(j)
        dot += score * weight.get(a[i], 1.0) * weight.get(b[j], 1.0)
        if not certain and not (len(a[i]) == len(b[j]) == 1):
            sure = False
            initials.append((a, used_a, i) if len(a[i]) < len(b[j]) else (b, used_b, j))
        if (w := weight.get(a[i], 1.0)) > key:  # the heaviest token they share
            key, exact_key = w, score == 1.0
    left, right = [x for i, x in enumerate(a) if i not in used_a], [y for j, y in enumerate(b) if j not in used_b]
    norm = math.sqrt(sum(weight.get(x, 1.0) ** 2 for x in a) * sum(weight.get(y, 1.0) ** 2 for y in b))
    sim = dot / norm if norm else 0.0
    if left and right:
        return sim, "no"
    # "K. D. Smith" is no Dorothy: the first initial stands for the name.
    if any(len(x[k]) == 1 and k not in used for x, used, i in initials for k in range(i)):
        return sim, "no"
    more = [x for x in left + right if len(x) > 1]
    if more and not (exact_key and sure):  # a missing name, and an initial that would stand for another
        return sim, "no"
    if more or not sure:
        return sim, "weak"
    return sim, "strong"


def _verify(threshold: float):
    """Nicknames are those listed and those quoted in the data for tokens of the two spellings (``na``, ``nb``)."""
    listed = {k: set(v.split()) for k, v in NICKNAMES.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plainly = lru_cache(maxsize=500_000)(partial(token_match, nicks=listed))
        for x in batches:
            out = []
            for ra, rb, wa, wb, na, nb in zip(x["ra"], x["rb"], x["wa"], x["wb"], x["na"], x["nb"], strict=True):
                match = plainly
                if na is not None or nb is not None:
                    nicks = dict(listed)
                    for n in (na, nb):
                        for t in n if n is not None else ():
                            nicks[t["token"]] = nicks.get(t["token"], set()) | {t["b"]}
                    match = partial(token_match, nicks=nicks)
                w = {t["t"]: t["w"] for s in (wa, wb) for t in s}
                best = max((compare(list(p), list(r), w, match) for p in ra for r in rb), key=lambda s: ({"no": 0, "weak": 1, "strong": 2}[s[1]], s[0]))
                out.append(best if best[0] >= threshold else (best[0], "no"))
            yield pd.DataFrame({"ia": x["ia"], "ib": x["ib"], "kind": [o[1] for o in out], "sim": [o[0] for o in out]}).query("kind != 'no'")

    return run


def link_names(signals: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``spelling, n, class_id, class_size, links``: every spelling with its class, the smallest id of those that mean the same, and its verified links.

    A spelling with a word that four in five spellings write small (``water inquiry``) is a general phrase and has a class of its
    own, as has one of no letters. Null arrays, null and blank names are none; repeated rows only add to ``n``. An empty
    table gives no rows. Ties are broken by the smaller spelling id, which only names the class.
    """
    spark = signals.sparkSession
    ship_package(spark)
    read_schema = "id long, spelling string, n long, readings array<array<string>>, nick string, lower array<string>, upper boolean"
    ids = spellings(signals).withColumn("id", F.monotonically_increasing_id())
    base = written(ids.select("id", "spelling", "n").mapInPandas(_read, read_schema))
    # Nicknames: those listed, and those quoted in the data with the names they stand for.
    listed = spark.createDataFrame([(k, x) for k, v in NICKNAMES.items() for x in v.split()], "token string, b string")
    quoted = base.where("nick is not null").select(F.regexp_extract("nick", r"^(\S*) (.*)$", 1).alias("token"), F.regexp_extract("nick", r"^(\S*) (.*)$", 2).alias("b")).distinct()
    quoted = written(quoted.join(listed, ["token", "b"], "left_anti"))
    known = written(listed.unionByName(quoted))

    small = base.where("not upper").select(F.explode(F.array_distinct("lower")).alias("token")).groupBy("token").agg(F.count("*").alias("small"))
    each = base.select("id", "upper", F.explode(F.array_distinct(F.flatten("readings"))).alias("token"))
    stats = each.groupBy("token").agg(F.count("*").alias("df"), F.count(F.when(~F.col("upper"), 1)).alias("seen"))
    stats = written(stats.join(small, "token", "left").select("token", "df", (F.coalesce("small", F.lit(0)) > 0.8 * F.greatest("seen", F.lit(1))).alias("general")))
    general = each.join(stats.where("general"), "token").select("id").distinct()
    names = base.join(general, "id", "left_anti").where(F.size(F.flatten("readings")) > 0)

    # A nickname is as common as the name it stands for. The names of nicknames too, as a typing error of one matches the nickname.
    near = similar_tokens(stats.select("token").unionByName(known.select(F.col("b").alias("token"))).distinct())
    more = near.join(stats.select(F.col("token").alias("b"), F.col("df").alias("dfb")), "b").groupBy(F.col("a").alias("token")).agg(F.max("dfb").alias("more"))
    full_df = known.join(stats.select(F.col("token").alias("b"), F.col("df").alias("dfb")), "b").groupBy("token").agg(F.max("dfb").alias("more"))
    more = more.unionByName(full_df).groupBy("token").agg(F.max("more").alias("more"))
    total = base.count()
    weight = stats.join(more, "token", "left").select("token", F.log(F.lit(1.0) + F.lit(float(max(total, 1))) / F.greatest("df", F.coalesce("more", F.lit(0)))).alias("w"))
    # Single letters say little.
    weight = weight.select("token", F.when(F.length("token") == 1, F.least("w", F.lit(0.5))).otherwise(F.col("w")).alias("w"))
    w = each.join(weight, "token").groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("o"), "token", "w"))).alias("ws"))
    own = each.join(quoted, "token").groupBy("id").agg(F.collect_list(F.struct("token", "b")).alias("nicks"))
    named = written(names.join(w, "id").join(own, "id", "left").select("id", "readings", "ws", "nicks"))
    pairs = candidates(named, soft_matches(stats.select("token"), near, known), threshold)
    side = lambda s: named.select(F.col("id").alias(f"i{s}"), F.col("readings").alias(f"r{s}"), F.transform("ws", lambda x: F.struct(x["token"].alias("t"), x["w"].alias("w"))).alias(f"w{s}"), F.col("nicks").alias(f"n{s}"))
    links = written(pairs.join(side("a"), "ia").join(side("b"), "ib").mapInPandas(_verify(threshold), "ia long, ib long, kind string, sim double"))

    strong = components(links.where("kind = 'strong'").select(F.greatest("ia", "ib").alias("u"), F.least("ia", "ib").alias("v")))
    cls = written(base.select("id", "readings").join(strong, "id", "left").select("id", F.coalesce("root", "id").alias("c"), F.element_at("readings", 1).alias("r")))
    # How much of the name the fullest spelling of a class says: its tokens that are written out.
    full = cls.groupBy("c").agg(F.max(F.size(F.filter("r", lambda t: F.length(t) > 2))).alias("full"))
    shape = cls.join(full, "c").select("id", "c", "full")
    a, b = shape.toDF("ia", "ca", "fa"), shape.toDF("ib", "cb", "fb")
    weak = links.where("kind = 'weak'").join(a, "ia").join(b, "ib").where("ca <> cb")
    up = F.col("fa") < F.col("fb")
    weak = weak.select(F.when(up, F.col("ca")).otherwise(F.col("cb")).alias("lo"), F.when(up, F.col("cb")).otherwise(F.col("ca")).alias("hi"), F.greatest("fa", "fb").alias("f"), "sim", F.abs(F.col("fa") - F.col("fb")).alias("d")).where("d > 0").groupBy("lo", "hi").agg(F.max("f").alias("f"))
    # Of the classes a short one can belong to, those that can themselves belong to another of them don't count.
    inner = weak.alias("x").join(weak.alias("y"), F.col("x.lo") == F.col("y.lo")).where("x.hi <> y.hi").join(weak.alias("z"), (F.col("z.lo") == F.col("x.hi")) & (F.col("z.hi") == F.col("y.hi"))).select(F.col("x.lo").alias("lo"), F.col("x.hi").alias("hi")).distinct()
    top = weak.join(inner, ["lo", "hi"], "left_anti")
    only = top.groupBy("lo").agg(F.count("*").alias("k"), F.min("hi").alias("hi")).where("k = 1")
    merged = components(only.select(F.greatest("lo", "hi").alias("u"), F.least("lo", "hi").alias("v")))
    final = cls.select("id", "c").join(merged.select(F.col("id").alias("c"), "root"), "c", "left").select("id", F.coalesce("root", "c").alias("class_id"))
    size = final.groupBy("class_id").agg(F.count("*").alias("class_size"))
    count = links.select(F.explode(F.array("ia", "ib")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    return base.select("id", "spelling", "n").join(final, "id").join(size, "class_id").join(count, "id", "left").select("spelling", "n", "class_id", "class_size", F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def name_pairs(signals: DataFrame) -> DataFrame:
    """``name_a, name_b``: all pairs of spellings of one class, the smaller by code point first. Classes hold the spellings of one name, not rows."""
    c = link_names(signals).where("class_size > 1").select("class_id", "spelling")
    a, b = c.toDF("class_id", "name_a"), c.toDF("class_id", "name_b")
    return a.join(b, "class_id").where("name_a < name_b").select("name_a", "name_b")
