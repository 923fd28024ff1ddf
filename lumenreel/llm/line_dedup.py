"""Cross-site boilerplate lines, by distinct-site spread.

A line's *spread* is the number of different sites (values of ``source``) whose documents hold it.  HyperLogLog sketches
per line hash are built in every map task and merged by aggregation, so a line in a third of all documents costs one
sketch a task.  Lines whose estimate lies near the threshold get an exact distinct count, over those lines only.  Lines
that reach the threshold are boilerplate: each stays at its first place (smallest doc_id, then position) and goes from
all others, so that no content is lost.

Lines are split at ``\n`` and compared after runs of ASCII white space have become one space and outer spaces are gone;
empty ones do not count.  A short line (fewer than ``min_words`` words, like a menu entry or a one-word sentence) says
little by itself, so its spread is that of the *run* of lines that it is in: from each line on, as many as have
``min_words`` words together, and the same back from a text's short last line.  Short lines go where such a run reaches the
threshold, long ones by their own spread only.  A text of fewer words is a run of its own, which equals no run inside others.

A null source is a site of its own.  Null texts stay null, texts without lines to remove are returned as they are.
Repeated rows hold their lines at the same place, and so keep or lose them together; different texts under one id keep and
lose lines each for itself.  Rows without ``doc_id`` are returned unchanged.  Other columns are carried in ``row``, where no name can clash.  Boilerplate is looked up in a
broadcast table of at most BROADCAST_LINES rows; beyond that, in SALTS shares of each line.
"""

from __future__ import annotations

from math import ceil, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenreel.llm.common import cut

#: Boilerplate lines (about 100 bytes each) that may be broadcast.
BROADCAST_LINES = 100_000
SALTS = 16


def _units(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, text_id, site, pos, gone, h, salt): long lines, and runs with short ones; ``gone``: the places that may go."""
    spaced = F.trim(F.regexp_replace(F.regexp_replace("text", r"[\x20\x09\x0B-\x0D]+", " "), " ?\n ?", "\n"))
    words = lambda x: F.length(x) - F.length(F.translate(x, " ", "")) + 1
    # Few words are seen at a line's first spaces; words are counted only where two short lines meet.
    few = (lambda x: x.rlike(f"^[^ ]+(?: [^ ]+){{0,{min_words - 2}}}$")) if min_words > 1 else lambda x: F.lit(False)
    lines = F.transform(F.filter(F.transform(F.split(spaced, "\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("line"))), lambda x: x["line"] != ""), lambda x: F.struct(x["pos"].alias("pos"), x["line"].alias("line"), few(x["line"]).alias("few")))
    rows = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_id"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("site"), lines.alias("lines"))

    def around(x: Column, k: Column) -> Column:
        """A line with the next one, and where these two have too few words, or there is no next, with what else its runs may need."""
        after = F.get("lines", k + 1)
        more = F.when(x["few"] & after["few"], F.slice("lines", k + 3, max(1, min_words - 2)))
        back = F.when(x["few"] & after.isNull(), F.reverse(F.slice("lines", F.greatest(F.lit(1), k + 2 - min_words), F.least(F.lit(min_words - 1), k))))
        return F.struct(x["pos"].alias("pos"), x["line"].alias("line"), x["few"].alias("few"), after.alias("next"), more.alias("more"), back.alias("back"))

    rows = rows.select("doc_id", "text_id", "site", F.explode(F.transform("lines", around)).alias("x"))
    rows = rows.select("doc_id", "text_id", "site", "x.*")
    short, after = F.col("few"), F.coalesce(F.col("next.few"), F.lit(False))
    n, m = words(F.col("line")), words(F.col("next.line"))
    enough = ~(short & after) | (n + m >= min_words)
    unit = lambda pos, gone, text: F.struct(pos.alias("pos"), gone.alias("gone"), text.alias("unit"))
    own = F.when(~short, unit(F.col("pos"), F.array("pos"), F.col("line")))
    two = F.array_compact(F.array(F.when(short, F.col("pos")), F.when(after, F.col("next.pos"))))
    pair = F.when((short | after) & F.col("next").isNotNull() & enough, unit(F.col("pos"), two, F.concat("line", F.lit("\n"), "next.line")))

    def run(first: Column, others: Column, before: bool) -> Column:
        """Lines are added to the first ones while these have too few words: (pos, gone, unit, n)."""

        def add(acc: Column, y: Column) -> Column:
            n = words(y["line"])
            text = F.concat(y["line"], F.lit("\n"), acc["unit"]) if before else F.concat(acc["unit"], F.lit("\n"), y["line"])
            gone = F.when(n < min_words, F.concat(acc["gone"], F.array(y["pos"]))).otherwise(acc["gone"])
            longer = F.struct((y["pos"] if before else acc["pos"]).alias("pos"), gone.alias("gone"), text.alias("unit"), (acc["n"] + n).alias("n"))
            return F.when(acc["n"] >= min_words, acc).otherwise(longer)

        return F.aggregate(others, first, add)

    ahead = run(F.struct(F.col("pos").alias("pos"), F.array("pos", "next.pos").alias("gone"), F.concat("line", F.lit("\n"), "next.line").alias("unit"), (n + m).alias("n")), F.col("more"), False)
    tail = run(F.struct(F.col("pos").alias("pos"), F.array("pos").alias("gone"), F.col("line").alias("unit"), n.alias("n")), F.col("back"), True)
    ahead = F.when(F.col("more").isNotNull() & ~enough & (ahead["n"] >= min_words), unit(ahead["pos"], ahead["gone"], ahead["unit"]))
    tail = F.when(F.col("back").isNotNull(), unit(tail["pos"], tail["gone"], F.when(tail["n"] >= min_words, tail["unit"]).otherwise(F.concat(tail["unit"], F.lit("\n")))))
    rows = rows.select("doc_id", "text_id", "site", F.explode(F.array_compact(F.array(own, F.coalesce(pair, ahead), tail))).alias("u"))
    return rows.select("doc_id", "text_id", "site", "u.pos", "u.gone", F.unhex(F.md5(F.col("u.unit").cast("binary"))).alias("h"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))


def boilerplate(docs: DataFrame, min_sites: int = 8, min_words: int = 3, lg_k: int = 12) -> DataFrame:
    """(h, first): digests of lines and runs that at least ``min_sites`` sites hold, and the first (doc_id, pos) of each."""
    return _common(cut(_units(docs, min_words)), min_sites, lg_k)


def _looked_up(units: DataFrame, table: DataFrame) -> DataFrame:
    """``units`` that are in ``table``, one row a digest, with its columns."""
    if table.count() <= BROADCAST_LINES:
        return units.join(F.broadcast(table), "h")
    return units.join(table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["h", "salt"])


def _common(units: DataFrame, min_sites: int, lg_k: int) -> DataFrame:
    spread = units.groupBy("h").agg(F.hll_sketch_agg("site", lg_k).alias("sites"), F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("n"))
    spread = spread.filter(F.col("n") >= min_sites).select("h", "first", F.hll_sketch_estimate("sites").alias("sites"))
    near = ceil(max(1.0, 4 * 1.04 / sqrt(2**lg_k) * min_sites))  # four standard errors of the estimate
    spread = cut(spread.filter(F.col("sites") >= min_sites - near))
    close = spread.filter(F.col("sites") <= min_sites + near).select("h", "first")
    exact = _looked_up(units, close).select("h", "site").distinct().groupBy("h").agg(F.count("*").alias("sites")).filter(F.col("sites") >= min_sites)
    return cut(spread.filter(F.col("sites") > min_sites + near).select("h", "first").union(close.join(exact.select("h"), "h")))


def remove_boilerplate(docs: DataFrame, min_sites: int = 8, min_words: int = 3, lg_k: int = 12) -> DataFrame:
    """(row, text, n_lines, n_removed): the rows of ``docs(doc_id, text, source, ...)``, and their texts without boilerplate."""
    units = cut(_units(docs, min_words))  # digests and places only: a small part of the text, and used three times
    hits = _looked_up(units, _common(units, min_sites, lg_k)).filter(F.struct("doc_id", "pos") > F.col("first"))
    gone = cut(hits.select("doc_id", "text_id", F.explode("gone").alias("pos")).groupBy("doc_id", "text_id").agg(F.collect_set("pos").alias("gone")))  # at most a text's lines
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_id"), F.struct("*").alias("row"), F.split("text", "\n").alias("lines")).join(gone, ["doc_id", "text_id"], "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(left, lambda p: F.get("lines", p)), "\n"))
    return rows.select("row", text.alias("text"), F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
