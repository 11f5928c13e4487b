"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Topics that labels may have, and what else they are called.
TOPICS = ["politics", "world", "business", "science_and_environment", "technology", "health", "education", "culture", "sport", "other"]
TOPIC_ALIASES = {
    "weather": "science_and_environment",
    "environment": "science_and_environment",
    "science": "science_and_environment",
    "crime": "other",
    "uk": "other",
    "travel": "other",
    "transport": "other",
    "religion": "other",
    "lifestyle": "other",
}
#: Entities that say nothing about an event; publishers add their own names.
GENERIC_ENTITIES = ["uk", "united kingdom", "government"]


def collapse_space(text: Column) -> Column:
    """Runs of white space (no-break spaces too) to one blank, trimmed."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"^ | $", "")


def embedding_text(title: Column, body: Column, length: int = 4000) -> Column:
    """Title, blank line and body cut to ``length``; a title repeated at the start of the body is left out, with marks after it."""
    t, b = F.coalesce(collapse_space(title), F.lit("")), F.coalesce(collapse_space(body), F.lit(""))
    rest = F.when((t != "") & F.startswith(b, t), F.regexp_replace(F.substr(b, F.length(t) + 1), r"^[ .:\-]+", "")).otherwise(b)
    return F.trim(F.concat(t, F.lit("\n\n"), F.substring(rest, 1, length)), F.lit(" \n"))


def truncate_utf8(text: Column, size: int) -> Column:
    """At most ``size`` bytes of UTF-8, without a broken character, within the JVM: the cut goes back to where a character begins."""
    b = F.encode(text, "UTF-8")
    inside = lambda i: F.hex(F.substring(b, i, 1)).rlike("^[89AB]") if i > 0 else F.lit(False)
    end = F.when(~inside(size + 1), size).when(~inside(size), size - 1).when(~inside(size - 1), size - 2).otherwise(size - 3)
    cut = F.substring(b, F.lit(1), F.greatest(end, F.lit(0))).cast("string")
    return F.when(F.octet_length(text) <= size, text).otherwise(cut)


def casefold(text: Column) -> Column:
    """Small letters for comparing, where folding makes more of them alike than ``lower`` does: sharp and long s, final sigma, ligatures."""
    folded = F.lower(text)
    for a, b in (("ß", "ss"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st")):
        folded = F.replace(folded, F.lit(a), F.lit(b))
    return F.translate(folded, "ſς", "sσ")


def label_tokens(text: Column) -> Column:
    """The set of runs of Latin letters and digits, in small letters."""
    return F.array_distinct(F.regexp_extract_all(casefold(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9]+)"), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets, 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def event_entities(names: Column, generic: list[str] = GENERIC_ENTITIES) -> Column:
    """Names trimmed, in small letters, once each, without empty and generic ones."""
    clean = F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda x: casefold(F.trim(x)))
    return F.array_sort(F.array_distinct(F.filter(clean, lambda x: x.isNotNull() & (x != "") & ~x.isin(generic))))


def lexical_score(title: Column, text: Column, terms: list[str]) -> Column:
    """Share of terms found: in the text for 1, in the title for 1.5 more, over 2.5 for each term given."""
    if not terms:
        return F.lit(0.0)
    low, head = F.lower(text), F.lower(title)
    hits = sum((F.contains(low, F.lit(t.lower())).cast("int") for t in terms), F.lit(0))
    title_hits = sum((F.contains(head, F.lit(t.lower())).cast("int") for t in terms), F.lit(0))
    return (hits + 1.5 * title_hits) / (2.5 * len(terms))


def topic(value: Column) -> Column:
    """Trimmed small letters, aliases resolved; null where it is no topic."""
    v = F.lower(F.trim(value))
    alias = F.create_map(*[F.lit(x) for kv in TOPIC_ALIASES.items() for x in kv])
    v = F.coalesce(F.try_element_at(alias, v), v)
    return F.when(v.isin(TOPICS), v)


def or_other(value: Column, default: str = "other") -> Column:
    """Trimmed small letters; empty and null are ``default``."""
    return F.coalesce(F.nullif(F.lower(F.trim(value)), F.lit("")), F.lit(default))


def or_default(value: Column, default: str) -> Column:
    """Empty and null are ``default``."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def string_list(values: Column, most: int) -> Column:
    """Items trimmed, empty ones left out, at most ``most``."""
    return F.slice(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")), 1, most)


def escape_html(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def human_label(value: Column) -> Column:
    return F.translate(value, "_", " ")


def citation_numbers(text: Column, most: Column) -> Column:
    """The numbers of marks like ``[3]`` between 1 and ``most``, sorted, once each."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: F.try_to_number(F.substring(x, 1, 9), F.lit("999999999")).cast("int"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x.between(1, most))))


def split_authors(text: Column) -> Column:
    """Names parted by semicolons, trimmed, sorted, once each."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(x)), lambda x: x != "")))


def searchable(*parts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *parts))


def search_link(base: str, query: Column) -> Column:
    """A link with an encoded query."""
    return F.concat(F.lit(base), F.url_encode(query))
