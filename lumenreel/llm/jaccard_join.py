"""Near-duplicate documents by an exact n-gram Jaccard join with grouped prefixes.

Two documents link when the Jaccard similarity of their sets of word shingles reaches a threshold; the result is the
connected component of each document.  The join is exact:

1. Documents with equal shingle sets become one *class* (hot groups of copies cost one row).
2. Each class keeps a *prefix*: its ``n - ceil(t*n) + 1`` first shingles in one global order.  Two sets that reach the
   threshold share a prefix shingle, whatever the order is; frequent shingles come last, so that prefixes are selective.
3. Classes with identical prefix and size become one *group*; prefixes are joined group by group.
4. Group pairs are filtered by size, by the position of the shared shingle, and by a parity signature with at least four
   bits for each shingle in which a pair may differ: the bits in which two signatures differ are a lower bound of that.
5. Surviving groups are expanded to their members, which are verified on whole shingle sets.

Links are needed only as far as they decide components.  A first round therefore verifies a star: each group against
its best-looking partner among the groups that lead a shared shingle's list, and each member against the group's first.
The second round takes *all* pairs of groups that pass the filters and still lie in different components, so no link
that would join two components is lost, while a large group of near copies does not emit its pairs.

Null or empty texts, and texts without words, have an empty set and link with nothing.  Texts with fewer words than a
shingle has have one shingle, the whole sequence.  Repeated rows are equal sets.  Rows without ``doc_id`` are returned
with a null component and link nothing; a ``doc_id`` with several texts counts as one node.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenreel.llm.common import cut, few_tasks, salted_join
from lumenreel.llm.graph import components
from lumenreel.llm.shingles import shingle_runs

#: The global order knows at most so many frequent shingles, so that it can be broadcast (16 bytes each). It decides
#: which shingles come first in a prefix, never which pairs are found.
ORDER_SIZE = 262_144
#: A shingle counts as frequent if so many rows of one Arrow batch have it.
FREQUENT_IN_BATCH = 3
#: Groups in a prefix shingle's list from which it is spread over tasks, and how many such shingles may be broadcast.
HOT_LIST = 10_000
BROADCAST_LISTS = 100_000
#: Pairs of one document up to which they are one task's work; beyond, they meet in many tasks.
HOT_PAIRS = 1_000
#: Bits of the smallest signature.
LEAST_BITS = 128
#: Largest prefilter (bits) for the documents to verify: 8 MB. Beyond it more documents pass, and the join drops them.
FILTER_BITS = 1 << 26


def _frequent(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of the corpus and their counts, ascending by shingle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, held = [], 0
            for _, h, _ in shingle_runs(b.column(0), k):
                parts.append(h)
                held += len(h)
                if held > 4_000_000:
                    yield out(np.concatenate(parts))
                    parts, held = [], 0
            if parts:
                yield out(np.concatenate(parts))

    def out(h: np.ndarray) -> pa.RecordBatch:
        v, n = np.unique(h, return_counts=True)
        often = n >= FREQUENT_IN_BATCH
        return pa.RecordBatch.from_arrays([pa.array(v[often].view(np.int64)), pa.array(n[often])], ["h", "n"])

    counts = cut(docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    # From which count on there are few enough: by a histogram of counts, of some hundred bins.
    bin_ = F.floor(F.log2("n") * 8)
    least, total = None, 0
    for r in sorted(counts.groupBy(bin_.alias("bin")).agg(F.count("*").alias("k")).collect(), reverse=True):
        total += r.k
        if total > ORDER_SIZE:
            break
        least = r.bin
    top = counts.filter(F.lit(False) if least is None else bin_ >= least).toArrow()
    h, n = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy()
    o = np.argsort(h)
    return h[o], n[o]


def _signatures(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Per document: set size, digest of the set, group digest, prefix in the global order, parity signature."""
    order = docs.sparkSession.sparkContext.broadcast(_frequent(docs, k))

    def digest(x: np.ndarray, n: int) -> np.ndarray:
        return np.frombuffer(hashlib.blake2b(x.tobytes() + n.to_bytes(8, "little"), digest_size=16).digest(), np.int64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, times = order.value
        for b in batches:
            ids = b.column(0)
            for i, h, to in shingle_runs(b.column(1), k):
                size, keys, bits, prefixes = [], [], [], []
                for d in range(len(to) - 1):
                    u = np.unique(h[to[d] : to[d + 1]])
                    n = len(u)
                    x = u
                    if len(often) and n:
                        at = np.minimum(np.searchsorted(often, u), len(often) - 1)
                        known = often[at] == u
                        if known.any():
                            x = u[np.lexsort((u, np.where(known, times[at], 0)))]
                    x = x[: n - -(-percent * n // 100) + 1] if n else x
                    size.append(n)
                    prefixes.append(x.view(np.int64))
                    keys.append(np.concatenate([digest(u, n), digest(x, n)]))
                    wide = max(LEAST_BITS, 1 << (8 * n * (100 - percent) // (100 + percent)).bit_length())
                    bits.append(np.packbits(np.bincount((u & np.uint64(wide - 1)).astype(np.int64), minlength=wide) & 1).view(np.int64))
                keys = np.array(keys)
                yield pa.RecordBatch.from_arrays([ids.slice(i, len(size)), pa.array(size, pa.int64()), *(pa.array(keys[:, c]) for c in range(4)), _lists(prefixes), _lists(bits)], ["doc_id", "n", "d1", "d2", "g1", "g2", "prefix", "bits"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sign, "doc_id long, n long, d1 long, d2 long, g1 long, g2 long, prefix array<long>, bits array<long>")


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows)))


def _wanted(ids: DataFrame) -> np.ndarray:
    """A bit per hashed id, as a prefilter of bounded size."""
    wide = min(FILTER_BITS, 1 << max(10, 4 + ids.count().bit_length()))
    at = F.pmod(F.col("id"), F.lit(wide))
    words = ids.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(id, {wide}) & 63 as int))")).alias("b")).toArrow()
    out = np.zeros(wide // 64, np.int64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out.view(np.uint64)


def _sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, h): whole shingle sets of the documents in ``ids``. Texts are not shuffled, only the sets that are wanted."""
    bits = docs.sparkSession.sparkContext.broadcast(_wanted(ids))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = bits.value
        for b in batches:
            at = np.asarray(b.column(0).fill_null(-1)) % (64 * len(wanted))
            keep = (wanted[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            b = b.filter(pa.array(keep))
            for i, h, to in shingle_runs(b.column(1), k):
                u = [np.unique(h[to[d] : to[d + 1]]).view(np.int64) for d in range(len(to) - 1)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(u)), _lists(u)], ["id", "h"])

    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(sets, "id long, h array<long>").join(ids, "id", "left_semi")


def _differ(x: str, y: str) -> Column:
    """Bits in which two signatures differ; the wider one is folded, which keeps parities."""

    def folded(a: str, b: str) -> Column:
        half = F.greatest(F.size(b), F.lit(1))
        return F.when(F.size(a) > F.size(b), F.zip_with(F.slice(a, F.lit(1), half), F.slice(a, half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(F.col(a))

    return F.aggregate(F.zip_with(folded(x, y), folded(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, n: t + n)


def _may(nx: Column, ny: Column, differ: Column, percent: int) -> Column:
    """|x ^ y| <= (1-t)/(1+t) * (|x|+|y|), with the signatures' lower bound on the left."""
    return differ * (100 + percent) <= (nx + ny) * (100 - percent)


def _sizes(nx: Column, ny: Column, percent: int) -> Column:
    return F.least(nx, ny) * 100 >= F.greatest(nx, ny) * percent


def _position(nx: Column, px: Column, ny: Column, py: Column, percent: int) -> Column:
    """Shingles that can still be shared from this one on, against those needed; holds at a true pair's first shared one."""
    return F.least(nx - px, ny - py) * (100 + percent) >= (nx + ny) * percent


def _shared_lists(posts: DataFrame, percent: int) -> DataFrame:
    """(token, g, n, pos, first): groups behind each prefix shingle that have a partner of fitting size there.

    In order of size, such a partner is a neighbour.  ``first`` is the group where the shingle comes earliest.  Lists of
    more than HOT_LIST groups are not sorted: their sizes are counted first, and looked up in shares.
    """
    hot = cut(posts.groupBy("token").count().filter(F.col("count") > HOT_LIST).select("token"))
    here = W.partitionBy("token")
    order = here.orderBy("n", "g")
    fits = lambda x: x.isNotNull() & _sizes(x, F.col("n"), percent)
    first = F.min(F.struct("pos", "g", "n"))
    columns = ["token", "g", "n", "pos", "first"]
    n = hot.count()
    few = F.broadcast(hot) if n <= BROADCAST_LISTS else hot
    cold = posts.join(few, "token", "left_anti") if n else posts
    cold = cold.withColumns({"first": first.over(here), "shared": fits(F.lag("n").over(order)) | fits(F.lead("n").over(order))}).filter("shared").select(*columns)
    if not n:
        return cold
    long = posts.join(few, "token", "left_semi")
    by_size = here.orderBy("n")
    sizes = long.groupBy("token", "n").agg(F.count("*").alias("k"), first.alias("first"))
    sizes = sizes.withColumns({"first": F.min("first").over(here), "shared": (F.col("k") > 1) | fits(F.lag("n").over(by_size)) | fits(F.lead("n").over(by_size))})
    return cold.unionByName(salted_join(long, sizes.filter("shared").select("token", "n", "first"), ["token", "n"], F.col("g")).select(*columns))


def _verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold."""
    pairs = cut(pairs.select("a", "b").distinct())
    n = pairs.count()
    if not n:
        return pairs
    pairs = few_tasks(pairs, n)
    sets = _sets(docs, cut(few_tasks(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), 2 * n)), k)
    most = lambda c: pairs.groupBy(c).count().agg(F.max("count")).first()[0]

    # A large family's first document is in many pairs: these meet in many tasks, each with one copy of its set. Where no
    # document has so many, its set stays where it is and only the pairs move.
    def with_set(rows: DataFrame, key: str, other: str) -> DataFrame:
        of = sets.select(F.col("id").alias(key), F.col("h").alias("h" + key))
        return salted_join(rows, of, [key], F.col(other)) if most(key) > HOT_PAIRS else rows.join(of, key)

    both = with_set(with_set(pairs, "a", "b"), "b", "a")
    both = both.select("a", "b", (F.size("ha") + F.size("hb")).alias("n"), F.size(F.array_intersect("ha", "hb")).alias("both"))
    return few_tasks(cut(both.filter(F.col("both") * 100 >= (F.col("n") - F.col("both")) * percent).select("a", "b")), n)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document of ``docs(doc_id, text)``: doc_id, n_shingles, component_id (smallest doc_id reachable).

    ``k``: words in a shingle; ``percent``: the Jaccard similarity from which two documents link, in hundredths.
    """
    sig = cut(_signatures(docs, k, percent))
    known = sig.filter("doc_id is not null and n > 0")
    classes = known.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("id"), F.first("g1").alias("g1"), F.first("g2").alias("g2"))
    classes = cut(classes)
    members = known.select("doc_id", "n", "d1", "d2").join(classes.select("n", "d1", "d2", "id"), ["n", "d1", "d2"]).select("doc_id", "id")
    groups = classes.groupBy("n", "g1", "g2").agg(F.min("id").alias("g"), F.count("*").alias("size"))
    rep = cut(classes.join(groups, ["n", "g1", "g2"]).select("id", "g", "n", "size", "d1", "d2"))
    n_classes = rep.count()
    rep = few_tasks(rep, n_classes)
    # Used six times below: kept once, as each use would put its join and exchanges into the driver's plans again.
    bits = known.select(F.col("doc_id").alias("id"), "n", "d1", "d2", "bits").join(rep.select("id", "n", "d1", "d2"), ["id", "n", "d1", "d2"], "left_semi")
    bits = cut(bits.select("id", "n", "bits"))

    posts = known.select(F.col("doc_id").alias("g"), "n", "d1", "d2", "prefix").join(rep.filter("id = g").select("g", "n", "d1", "d2"), ["g", "n", "d1", "d2"])
    posts = cut(_shared_lists(posts.select("g", "n", F.posexplode("prefix").alias("pos", "token")), percent))

    # First round: a star in each group and around the first group of each list.
    star = posts.filter(F.col("g") != F.col("first.g")).filter(_sizes(F.col("n"), F.col("first.n"), percent) & _position(F.col("n"), F.col("pos"), F.col("first.n"), F.col("first.pos"), percent))
    star = star.select(F.col("g").alias("id"), F.col("first.g").alias("to")).union(rep.filter("id <> g").select("id", F.col("g").alias("to"))).distinct()
    star = star.join(bits.select("id", F.col("n").alias("nx"), F.col("bits").alias("x")), "id").join(bits.select(F.col("id").alias("to"), F.col("n").alias("ny"), F.col("bits").alias("y")), "to")
    star = star.filter(_sizes(F.col("nx"), F.col("ny"), percent)).withColumn("differ", _differ("x", "y")).filter(_may(F.col("nx"), F.col("ny"), F.col("differ"), percent))
    star = star.groupBy("id").agg(F.min_by("to", F.struct(F.col("differ") / (F.col("nx") + F.col("ny")), F.col("to"))).alias("to"))
    links = _verified(star.select(F.col("id").alias("a"), F.col("to").alias("b")), docs, k, percent)

    # Second round: all pairs that pass the filters and may still join two components.
    label = components(links)
    rep = few_tasks(cut(rep.join(label.withColumnRenamed("node", "id"), "id", "left").select("id", "g", "n", "size", F.coalesce("component", "id").alias("c"))), n_classes)
    spread = rep.groupBy("g", "n").agg(F.min("c").alias("c0"), F.max("c").alias("c1"))
    one = rep.join(bits, ["id", "n"]).select("id", "g", "n", "c", "bits")
    far = rep.filter("size > 1").select("id", "g", "n").join(bits, ["id", "n"]).join(bits.select(F.col("id").alias("g"), "n", F.col("bits").alias("of")), ["g", "n"])
    far = far.groupBy("g", "n").agg(F.max(_differ("bits", "of")).alias("radius"))
    lists = posts.select("token", "g", "n", "pos").join(spread, ["g", "n"])
    mixed = lists.groupBy("token").agg(F.min("c0").alias("low"), F.max("c1").alias("high")).filter("low <> high").select("token")
    lists = lists.join(mixed, "token", "left_semi").join(bits.withColumnRenamed("id", "g"), ["g", "n"]).join(far, ["g", "n"], "left")
    # Sizes that fit lie in the same band or in neighbouring ones, so a long list is joined band by band: each group, as
    # the smaller one of a pair, meets its own band and the next.
    band = F.floor(F.log("n") / math.log(100 / percent)).cast("int") if percent < 100 else F.col("n").cast("int")
    lists = cut(lists.select("token", "g", "n", "pos", "c0", "c1", F.coalesce("radius", F.lit(0)).alias("radius"), "bits", band.alias("band")))
    x, y = lists.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1))).alias("x"), lists.alias("y")
    same = (F.col("x.c0") == F.col("x.c1")) & (F.col("y.c0") == F.col("y.c1")) & (F.col("x.c0") == F.col("y.c0"))
    cheap = (F.col("x.token") == F.col("y.token")) & (F.col("x.band") == F.col("y.band")) & (F.struct("x.n", "x.g") < F.struct("y.n", "y.g")) & ~same & _sizes(F.col("x.n"), F.col("y.n"), percent)
    pairs = x.join(y, cheap & _position(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"), percent) & _may(F.col("x.n"), F.col("y.n"), _differ("x.bits", "y.bits") - F.col("x.radius") - F.col("y.radius"), percent))
    pairs = pairs.select(F.col("x.g").alias("gx"), F.col("y.g").alias("gy"), F.col("x.n").alias("nx"), F.col("y.n").alias("ny"))
    torn = spread.filter("c0 <> c1").select(F.col("g").alias("gx"), F.col("g").alias("gy"), F.col("n").alias("nx"), F.col("n").alias("ny"))
    pairs = cut(pairs.union(torn).distinct())
    both = pairs.join(one.select(F.col("id").alias("a"), F.col("g").alias("gx"), F.col("n").alias("nx"), F.col("c").alias("ca"), F.col("bits").alias("x")), ["gx", "nx"])
    y = one.select(F.col("id").alias("b"), F.col("g").alias("gy"), F.col("n").alias("ny"), F.col("c").alias("cb"), F.col("bits").alias("y"))
    both = both.alias("p").join(y.alias("q"), (F.col("p.gy") == F.col("q.gy")) & (F.col("p.ny") == F.col("q.ny")) & (F.col("ca") != F.col("cb")) & _may(F.col("nx"), F.col("p.ny"), _differ("x", "y"), percent))
    more = _verified(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), docs, k, percent)

    # Classes are named by their smallest document, so a component's smallest class is its smallest document.
    label = components(label.select(F.col("component").alias("a"), F.col("node").alias("b")).union(more)) if not more.isEmpty() else label
    out = sig.select("doc_id", F.col("n").alias("n_shingles")).join(members.groupBy("doc_id").agg(F.min("id").alias("id")), "doc_id", "left")
    out = out.join(label.select(F.col("node").alias("id"), "component"), "id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "id", "doc_id").alias("component_id"))
