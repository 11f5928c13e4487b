"""Snapshots that hold template residue, filler, an error page or a notice that scripts are needed, in place of reporting.

Three kinds of evidence are combined, all as column expressions:

* Placeholder detectors: marks that templates leave when a value is missing, filler text, traces of failed programs. They
  count wherever they stand, in a title or within a story, unless the text quotes exactly that mark and so reports on it;
  filler phrases count where they are a sentence.
* Notice detectors: what error pages and script walls say. They count only where nothing else is told: a page is low in
  information if every sentence of it is a notice or served for other stories too, however long it is.
* Host evidence: a sentence is duplicated if, digits and codes aside, it is served for several stories of a host by pages
  that could be low in information. Where no detector knows any sentence of a page of such sentences, it is flagged if the
  whole response is duplicated, and mismatched too: it shares no term with its title or address slug.

A page can be low in information only if its longest sentence is a notice or duplicated, which is counted first, over all
snapshots; only such pages are taken apart into sentences. Counts are by (host, sentence) with partial aggregation; a
host may hold all rows.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.session import written

_NAME = r"[A-Za-z][A-Za-z0-9_.]*"
#: Marks of templating languages and of editors, each around a name, by what a text must hold to have one.
MARKS = {
    "{": r"\{\{\s*" + _NAME + r"\s*\}\}|\{%[^%\n]{1,60}%\}|[$#%]?\{\s*" + _NAME + r"\s*\}",
    "%(": r"%\(" + _NAME + r"\)[sdf]",
    "<%": r"<%[=-]?[^%\n]{1,60}%>",
    "<<": r"<<\s*" + _NAME + r"\s*>>",
    "[[": r"\[\[\s*" + _NAME + r"\s*\]\]",
    " TK]": r"\[[^\[\]\n]{1,40}\s+TK\]",
    "[INSERT": r"\[INSERT\s[^\[\]\n]{1,40}\]",
    "@@": r"@@" + _NAME + r"@@",
    "%%": r"%%" + _NAME + r"%%",
    "__": r"(?<!\w)__" + _NAME + r"__(?!\w)",
    "?": r"(?<![\w?])\?[A-Za-z]\w*(?:\.\w+)*\?(?!\w)",
    "»_TBC": r"«" + _NAME + r"»_TBC",
    "data-bind:": r"\bdata-bind:" + _NAME,
    **{f".{end}": r"(?<![\w@/.-])[a-z]{3,}(?:\.[A-Za-z_]{2,}){1,4}\." + end + r"\b" for end in ("label", "title", "text", "name", "heading", "caption", "message", "placeholder", "html")},
}
MARK = "(?:" + "|".join(MARKS.values()) + ")"
#: Traces of programs that failed while a page was made, in the same way.
TRACES = {
    "[object Object]": r"\[object Object\]",
    "Exception": r"\w+Exception (?:at|in) \w",
    "Error at ": r"\w+Error at \w",
    "failed to open stream": r"failed to open stream",
    "Traceback": r"Traceback(?: \(most recent|: )",
    "template render failed": r"template render failed",
    "undefined": r"(?:^|\n)\s*undefined\s*(?:\n|$)",
    "null": r"(?:^|\n)\s*null\s*(?:\n|$)",
    "NaN": r"(?:^|\n)\s*NaN\s*(?:\n|$)",
}
LOREM = (
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint "
    "occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum vestibulum pellentesque mattis viverra vivamus praesent donec maecenas"
).split()
#: What a filler sentence begins with, and what a text must hold (in small letters) to have one.
FILLER_PARTS = ("goes here", "here please", "to come", "to follow", "tbc", "dummy ", "placeholder ", "filler ", "sample ", "do not publish")
FILLER = (
    r"(?im)(?:^|[.!?…]\s)[^\S\n]*(?:(?:the |this |your |insert )?(?:body|text|copy|headline|heading|title|caption|standfirst|summary|byline|quote|image)(?: text| copy)? (?:goes here|here please|to come\b|to follow\b|tbc\b)"
    r"|(?:dummy|placeholder|filler|sample) (?:copy|text|paragraph|headline|story)\b|do not publish\b)[^.!?…\n“”\"]{0,40}(?:[.!?…]|$)"
)
#: A sentence of one word said three times or more.
STUTTER = r"(?im)(?:^|[.!?…]\s)[^\S\n]*(\w+)(?: \1){2,}(?:[.!?…]|$)"
#: Titles that name no story.
TITLE_FILLER = r"(?i)^\s*(?:(?:test|dummy|sample|new|blank|untitled)(?: (?:story|article|page|document|post|headline|template|title))+(?: \d+)?|test please ignore|(?:page |story )?layout test|.{0,30}\(max\.? \d+ char(?:acter)?s\)|(?:x{3,}|\.{3,}|-{3,}|#{3,}|tbc|tk)(?: (?:x{3,}|\.{3,}|-{3,}|#{3,}|tbc|tk))*|undefined|null|nan|\[object Object\])\s*$"
NOTICE = (
    r"(?i)(?:"
    r"(?:enable|activ\w+|turn(?:ed)? on|switch on|allow|needs?|requires?|without) (?:\w+ ){0,3}(?:java ?script|scripts|scripting|cookies)"
    r"|(?:java ?script|scripts?|scripting|cookies) (?:\w+ ){0,3}(?:disabled|required|turned off|switched off|not (?:enabled|supported))"
    r"|(?:aktivieren|active|habilite|abilita|attiva|activez) (?:\w+ ){0,3}java ?script|cannot load without it|turn them on in your browser|allow scripts|browser is (?:not supported|out of date|outdated)|checking your browser|(?:confirm|verify|prove) (?:that )?you are (?:a |an |not )?\w+|^just a moment|^attention required|unusual traffic|not a robot|captcha"
    r"|(?:page|story|article|link|resource|address|document|site|url|it)\b.{0,40}(?:not be found|cannot be found|not found|has expired|no longer (?:available|exists)|has been removed|does(?: not|n.t) exist|is not here|may have moved|is down for|was typed wrongly)"
    r"|^not found\b|introuvable|n.existe (?:plus|pas)|nicht gefunden|no encontrad[ao]|sp(?:ä|ae)ter erneut|r(?:é|e)essayez|int(?:é|e)ntelo"
    r"|^access denied\b|^forbidden\b|not have permission|permission denied|too many requests|not available in your (?:area|region|country)"
    r"|internal (?:server )?error|server error|(?:bad|proxy) gateway|gateway time-?out|service unavailable|temporarily unavailable|took too long to (?:answer|respond)|upstream connect error|connection (?:lost|refused|reset|timed out)|down for (?:\w+ )?(?:work|maintenance)|(?:systems|servers|we) are (?:very )?busy|expect to be back|try again (?:later|in a|soon)|^something went wrong|stopped this request|^we.re sorry\W*$|^sorry\W*$|^oops\W*$|^error(?: \d{3})?\W*$|^http \d{3}\b|^(?:error )?[45]\d\d(?: [A-Z][\w-]+){0,3}\W*$"
    r"|^\{\s*\"(?:error|status|code|message)\"|^<(?:error|\?xml)|errno \d+"
    r")"
)
#: What stands around a notice.
FURNITURE = r"(?i)©.*|\bcopyright\b.*|\b(?:home|news|sport|weather|contact|terms)\b|\b(?:reference|incident|ray|request)(?: id)?:?\s+[^\s,]+(?:, node \S+)?|\bgo back to the front page\b|\bsearch the site\b|^[\w-]+/[\d.]+"
_QUOTES = "“”\"'‘’«»„"


def _unquoted(text: Column, patterns: dict[str, str]) -> Column:
    """Whether one of ``patterns`` stands in ``text`` other than as the whole of a quotation. Patterns are tried only where their literal part is."""

    def one(part: str, pattern: str) -> Column:
        found = text.contains(part) & text.rlike(pattern)
        bare = F.regexp_replace(text, f"[{_QUOTES}](?:{pattern})[{_QUOTES}]", " ").rlike(pattern)
        return F.when(found, bare).otherwise(F.lit(False))

    return reduce(or_, [one(*x) for x in patterns.items()])


def sentences_of(text: Column) -> Column:
    """Rough sentences without their end marks."""
    return F.filter(F.transform(F.split(text, r"[.!?…][”\"’']?\s+|\n"), lambda s: F.trim(s)), lambda s: s != "")


def alike(text: Column) -> Column:
    """A text whose numbers and cases are made alike."""
    return F.regexp_replace(F.translate(F.lower(text), "012345678", "999999999"), "9+", "9")


def low_filler(text: Column) -> Column:
    """A line of at least six words of which half are blind text, or of at least eight that are but one or two different ones."""
    words = lambda line: F.filter(F.split(F.lower(line), r"[^\p{L}\p{N}.]+"), lambda w: w != "")
    blind = F.array(*[F.lit(w) for w in LOREM])

    def filler(line: Column) -> Column:
        w = F.transform(words(line), lambda x: F.regexp_replace(x, r"\.+$", ""))
        known = F.size(F.filter(w, lambda x: F.array_contains(blind, x)))
        same = (F.size(words(line)) >= 8) & (F.size(F.array_distinct(words(line))) <= 2)
        return ((known >= 6) & (known * 2 >= F.size(w))) | same

    # Only texts that can hold such a line are taken apart: half of the words of a blind line are common ones of the passage.
    small = F.lower(text)
    suspect = reduce(or_, [small.contains(w) for w in ("ipsum", "vestibulum", "pellentesque", "nostrud", "laboris", "ullamco", "fugiat", "cillum", "veniam", "consequat", "cupidatat", "exercitation", "deserunt", "aliqua")])
    suspect = suspect | text.rlike(r"(?im)^\W*(\S{1,40}) +\1 +\1\b|^\W*(\S{1,40}) +\2 +\2 ")
    return F.when(suspect, F.exists(F.split(text, r"\n"), filler)).otherwise(F.lit(False))


def find_residue(snapshots: DataFrame, stories: int = 3) -> DataFrame:
    """One row per snapshot: ``snapshot_id, marks, filler, title_residue, notice, low_information, mismatched, residue``.

    Repeated rows count once (of rows of one snapshot_id that differ, one with residue holds). A null title or text is an
    empty one; a snapshot without id doesn't come out, and one with neither title nor text is no residue. An empty table
    gives no rows. Extra columns are ignored.
    """
    clean = lambda c: F.coalesce(c, F.lit(""))
    s = snapshots.where("snapshot_id is not null").select(
        "snapshot_id", F.coalesce("story_id", "canonical_url", "snapshot_id").alias("story"), clean(F.col("title")).alias("title"), clean(F.col("article_text")).alias("text"),
        F.coalesce(F.regexp_extract("canonical_url", r"^\w+://([^/]+)", 1), F.lit("")).alias("host"), F.coalesce(F.regexp_extract("canonical_url", r"([^/]*)/?$", 1), F.lit("")).alias("slug"),
    )
    title, text = F.col("title"), F.col("text")
    quoted_marks = F.regexp_extract_all(text, F.lit(f"[{_QUOTES}]({MARK})[{_QUOTES}]"), F.lit(1))
    in_title = F.regexp_extract(title, f"({MARK})", 1)
    marks = _unquoted(text, MARKS) | _unquoted(text, TRACES)
    title_marks = F.when(in_title == "", False).otherwise(_unquoted(title, MARKS) & ~F.array_contains(quoted_marks, in_title))
    small = F.lower(text)
    filler = F.when(reduce(or_, [small.contains(x) for x in FILLER_PARTS]), text.rlike(FILLER)).otherwise(F.lit(False)) | text.rlike(STUTTER)
    longest = F.array_max(F.transform(sentences_of(text), lambda x: F.struct(F.length(x).alias("n"), x.alias("s"))))["s"]
    head = s.select(
        "snapshot_id", "host", "story", "title", "slug", "text",
        marks.alias("marks"),
        (low_filler(text) | filler).alias("filler"),
        (title_marks | title.rlike(TITLE_FILLER) | title.rlike(r"(?i)^\W*(?:headline|title|caption) (?:goes here|to come|to follow|tbc)\W*$")).alias("title_residue"),
        longest.alias("longest"),
    )
    told = lambda x: x.rlike(NOTICE) & ~x.rlike(f"[{_QUOTES}][^{_QUOTES}]*{NOTICE}[^{_QUOTES}]*[{_QUOTES}]")
    furniture = lambda x: ~F.regexp_replace(x, FURNITURE, " ").rlike(r"[\p{L}\p{N}]")

    def duplicated(rows: DataFrame) -> DataFrame:
        """``host, t, served``: sentences of at least so many stories of a host."""
        return rows.select("host", "t", "story").distinct().groupBy("host", "t").agg(F.count("*").alias("n")).where(F.col("n") >= stories).select("host", "t", F.lit(True).alias("served"))

    head = written(head.withColumn("t", F.xxhash64(alike(F.col("longest")))))
    terms = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}]+"), lambda w: F.length(w) > 3)
    mismatch = ~F.arrays_overlap(F.array_union(terms(F.col("title")), terms(F.col("slug"))), terms(F.col("text"))) | F.col("title").rlike(NOTICE)
    told_longest = head.where("longest is not null")
    could = told_longest.join(duplicated(told_longest), ["host", "t"], "left").where(F.coalesce("served", F.lit(False)) | told(F.col("longest")) | furniture(F.col("longest")))
    could = written(could.select("snapshot_id", "host", "story", "text", mismatch.alias("mismatched")))
    mismatched = could.groupBy("snapshot_id").agg(F.max("mismatched").alias("mismatched"))
    whole = could.select("snapshot_id", "host", "story", F.xxhash64(alike(F.col("text"))).alias("t"))
    whole = whole.join(duplicated(whole), ["host", "t"]).groupBy("snapshot_id").agg(F.lit(True).alias("response"))
    each = could.select("snapshot_id", "host", "story", F.explode(sentences_of(F.col("text"))).alias("x")).withColumn("t", F.xxhash64(alike(F.col("x"))))
    each = each.select("snapshot_id", "host", "story", "t", told(F.col("x")).alias("notice"), furniture(F.col("x")).alias("furniture"))
    judged = each.join(duplicated(each), ["host", "t"], "left").groupBy("snapshot_id").agg(
        F.max("notice").alias("notice"),
        F.min(F.coalesce("served", F.lit(False)) | F.col("notice") | F.col("furniture")).alias("low_information"),
    )
    judged = judged.join(mismatched, "snapshot_id")
    out = head.join(judged.join(whole, "snapshot_id", "left"), "snapshot_id", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    page = flag("low_information") & (flag("notice") | (flag("response") & flag("mismatched")))
    residue = F.col("marks") | F.col("filler") | F.col("title_residue") | page
    picked = out.select("snapshot_id", "marks", "filler", "title_residue", flag("notice").alias("notice"), flag("low_information").alias("low_information"), flag("mismatched").alias("mismatched"), residue.alias("residue"))
    cols = [c for c in picked.columns if c != "snapshot_id"]
    return picked.groupBy("snapshot_id").agg(F.max(F.struct("residue", *[c for c in cols if c != "residue"])).alias("r")).select("snapshot_id", *[f"r.{c}" for c in cols])
