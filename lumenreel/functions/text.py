"""Cleaning and building of texts, lists, identifiers and time codes as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separators, limits and labels of a search text, in their order.
SEARCH_LISTS = (("Mood: ", "mood", 5), ("Scene: ", "scene_elements", 8), ("Activities: ", "activity", 5))
FALLBACK_DESCRIPTION = " 관련 드라마 촬영 장면입니다."
SEASONS = ("봄", "여름", "가을", "겨울")


def strip(c: Column) -> Column:
    """Without white space at both ends, in the Unicode sense."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def text_or_null(c: Column) -> Column:
    """Trimmed text; null if it is empty or says ``unknown``."""
    t = strip(c)
    return F.when(~F.lower(t).isin("", "unknown"), t)


def text_or_empty(c: Column) -> Column:
    return F.coalesce(text_or_null(c), F.lit(""))


def unique_strings(a: Column) -> Column:
    """Distinct usable strings of a list, compared without case; first spelling and order are kept; null gives ``[]``."""
    usable = F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), text_or_null), lambda x: x.isNotNull())
    marked = F.array_sort(F.transform(usable, lambda x, i: F.struct(F.lower(x).alias("key"), i.alias("i"), x.alias("x"))))
    # Bound once by a one-element array, as the filter looks at neighbours: a sort, where a fold would be quadratic.
    first = F.transform(F.array(marked), lambda m: F.filter(m, lambda v, k: (k == 0) | (F.get(m, k - 1)["key"] != v["key"])))[0]
    return F.transform(F.array_sort(F.transform(first, lambda v: F.struct(v["i"], v["x"]))), lambda v: v["x"])


def unique_exact(a: Column) -> Column:
    return F.array_distinct(a)


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def hangul_only(c: Column) -> Column:
    """Hangul syllables, digits and single spaces; null gives an empty text."""
    return F.coalesce(collapse(F.regexp_replace(c, r"(?U)[^가-힣0-9\s]", " ")), F.lit(""))


def without_words(a: Column, banned: Sequence[str]) -> Column:
    """Cleaned list entries without empty ones and those that hold a banned word, distinct."""
    clean = F.transform(a, hangul_only)
    return F.array_distinct(F.filter(clean, lambda x: (x != "") & ~F.array_contains(F.lit(list(banned)).cast("array<string>"), x)))


def without_phrases(c: Column, phrases: Sequence[str], place: Column) -> Column:
    """Text without banned phrases, removed in list order; if nothing is left, a sentence about the place."""
    for p in phrases:
        c = F.replace(c, F.lit(p), F.lit(""))
    return F.coalesce(text_not_empty(collapse(c)), F.concat(place, F.lit(FALLBACK_DESCRIPTION)))


def text_not_empty(c: Column) -> Column:
    return F.when(c != "", c)


def safe_name(c: Column) -> Column:
    """An identifier of letters, digits, ``-`` and ``_``; ``video`` if nothing is left."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}_-]", "_"), r"^_+|_+$", "")
    return F.coalesce(text_not_empty(t), F.lit("video"))


def file_stem(path: Column) -> Column:
    """Name of a file without its directories and its last suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def keyframe_id(segment: Column, path: Column) -> Column:
    return F.concat(segment, F.lit("__"), file_stem(path))


def search_text(item: dict[str, Column]) -> Column:
    """One item's search text: its usable parts, joined by ``. ``.

    ``item`` names columns: spot_name, place_name, region, drama_title, season, time_of_day, description and the lists
    mood, scene_elements, activity; missing ones are left out.
    """
    none = F.lit(None).cast("string")
    text = {k: text_or_null(item.get(k, none)) for k in ("spot_name", "place_name", "region", "drama_title", "season", "time_of_day", "description")}
    when = text_not_empty(F.concat_ws(" ", text["season"], text["time_of_day"]))
    parts = [text["spot_name"], text["place_name"], text["region"], text["drama_title"], when, text["description"]]
    for label, name, most in SEARCH_LISTS:
        some = F.slice(unique_strings(item.get(name, F.lit(None).cast("array<string>"))), 1, most)
        parts.append(F.when(F.size(some) > 0, F.concat(F.lit(label), F.array_join(some, ", "))))
    return F.concat_ws(". ", *parts)


def timecode(seconds: Column) -> Column:
    """``HH:MM:SS.mmm``, milliseconds rounded half to even."""
    ms = F.bround(seconds * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def midpoint_unless(t: Column, start: Column, end: Column) -> Column:
    return F.coalesce(t, (start + end) / 2)


def rescued_json(reply: Column) -> Column:
    """A reply's outermost object as a variant; a reply that was cut off is closed once; null if it still does not parse."""
    found = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    text = F.when(found != "", found).otherwise(strip(reply))
    closed = F.concat(text, F.when(text.endswith('"'), "").otherwise('"'), F.lit("}"))
    return F.coalesce(F.try_parse_json(text), F.when(~text.endswith("}"), F.try_parse_json(closed)))


def expected_seasons(expected: Column, season: Column, verified: Column) -> Column:
    """List of expected seasons: ``expected`` (comma separated) or else ``season``; a valid verified season replaces it."""
    given = F.coalesce(text_not_empty(strip(expected)), season, F.lit(""))
    some = F.filter(F.transform(F.split(given, ","), strip), lambda x: x != "")
    return F.when(verified.isin(*SEASONS), F.array(verified)).otherwise(some)
