"""Quality rules: two fixed base rules, then robust multivariate outliers.

Every document has a few statistics, counted over its whole text in SQL expressions.  Documents that pass the base rules
give transformed vectors: mean word length (log), and the roots of the rates of symbols, repeated lines and repeated
windows.  Rates are shrunk by a few pseudo-observations (PRIOR), as one repeated line of three says less than 40 of 100.

A minimum-covariance-determinant estimate is made for each language and source, for each language, and for all rows.
From several deterministic starts (robust scales; correlations of tanh scores; spatial signs) concentration steps take
the ``coverage`` share of rows with the smallest distances to the next mean and covariance.  The start whose covariance
then has the least determinant is followed further, and its estimate is reweighted: mean and covariance of the rows
within the chi-square quantile REWEIGHT.  Both covariances have their consistency factor.  A feature that is constant in
a core (most clean documents have no symbols or repeated lines at all) has a singular covariance, for which any
deviation is infinitely far; so each feature's variance has the smallest deviation that is held for real, FLOOR, added.

A small group's estimate is shrunk towards its language's, and that towards the estimate of all rows, as the moments of a
mixture with the weight ``n / (n + shrink)``: continuous in the group's size, and wider where a small group's own mean
differs.  A document whose Mahalanobis distance exceeds ``cutoff`` goes.

All steps are mergeable aggregates (sums, quantile sketches) and joins with a table of one row a group, which is
broadcast while it has at most BROADCAST_GROUPS rows; beyond that, rows and groups are joined in SALTS shares.  So a
group with a third of all rows is spread over many tasks.

Null texts have no words, and so fail the base rules.  Null language and source are values of their own.  Repeated rows
are judged alike.  Rows without ``doc_id`` are judged like others.  An empty table gives an empty result.  Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from math import exp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenreel.llm.common import cut

_SPACES = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"
FEATURES = ["x0", "x1", "x2", "x3"]
#: Pseudo-observations without a finding: characters, lines and words.
PRIOR = (100, 20, 50)
#: Smallest spread of each feature, in its units.
FLOOR = (0.01, 0.04, 0.08, 0.10)
#: Root of the chi-square quantile at 1 - 1e-5, for as many degrees of freedom as features.
CUTOFF = 5.336
#: Share of clean rows that the reweighting keeps.
REWEIGHT = 0.975
#: Groups (about 250 bytes each) that may be broadcast.
BROADCAST_GROUPS = 20_000
SALTS = 64
#: Rows that a task of the fit takes, and the least number of its tasks.
ROWS_A_TASK = 100_000
LEAST_TASKS = 8


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur at least twice, the first occurrence included."""

    def covered(hashes: Column) -> Column:
        marked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            twice = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
            return F.array_sort(F.transform(twice, lambda x: x["i"]))

        def words_in(p: Column) -> Column:
            steps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1), x + 3) - x))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return _let(_let(marked, starts), words_in)

    def count(w: Column) -> Column:
        windows = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return _let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))

    return _let(words, count)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines of every document."""
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(F.translate(text, _SPACES, " " * len(_SPACES)), " "), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, _SPACES, "") != "")
    found = _let(words, lambda w: F.struct(F.size(w).alias("n_words"), _repeat_words(w).alias("n_repeat_words")))
    of_lines = _let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "lang", "source", F.length(F.translate(text, _SPACES, "")).alias("word_chars"), (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"), found.alias("w"), of_lines.alias("l"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
    at = {"n_words": "w.n_words", "n_repeat_words": "w.n_repeat_words", "n_lines": "l.n_lines", "n_dup_lines": "l.n_dup_lines"}
    return rows.select("doc_id", "text_hash", "lang", "source", *(F.col(at.get(n, n)).cast("long").alias(n) for n in names))


def _vector() -> list[Column]:
    chars, lines, words = PRIOR
    rate = lambda x, of, more: F.sqrt(F.col(x) / (F.col(of) + more))
    length = F.log(F.greatest("word_chars", F.lit(1)) / F.greatest("n_words", F.lit(1)))
    return [length, rate("n_symbols", "word_chars", chars), rate("n_dup_lines", "n_lines", lines), rate("n_repeat_words", "n_words", words)]


# ---- minimum covariance determinant

_D = range(len(FEATURES))
_PAIRS = [(i, j) for i in _D for j in range(i, len(FEATURES))]


def _chi2(x: float, degrees: int) -> float:
    """Distribution function of chi-square with an even number of degrees of freedom."""
    term, total = 1.0, 0.0
    for i in range(degrees // 2):
        total, term = total + term, term * x / 2 / (i + 1)
    return 1 - exp(-x / 2) * total


def _quantile(share: float) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        low, high = ((low + high) / 2, high) if _chi2((low + high) / 2, len(FEATURES)) < share else (low, (low + high) / 2)
    return low


def _consistency(share: float) -> float:
    """What the covariance of the nearest ``share`` of normal rows is too small by."""
    return share / _chi2(_quantile(share), len(FEATURES) + 2)


def _sum(terms: list[str]) -> str:
    return " + ".join(terms) or "0D"


def _factored(models: DataFrame) -> DataFrame:
    """``models`` with ``logdet`` and the inverse Cholesky factor (``w``) of their covariances; one row a group."""
    for j in _D:  # one column of the factor after the other, from the diagonal down
        rest = {i: f"(c{j}{i} - ({_sum([f'l{i}{k} * l{j}{k}' for k in range(j)])}))" for i in range(j, len(FEATURES))}
        pivot = f"sqrt(greatest({rest[j]}, {FLOOR[j] ** 2 / 100}D))"
        models = models.selectExpr("*", *(f"{pivot if i == j else f'{x} / {pivot}'} AS l{i}{j}" for i, x in rest.items()))

    def inverse(i: int, j: int) -> str:
        return f"(1 / l{i}{i})" if i == j else f"(-({_sum([f'l{i}{k} * {inverse(k, j)}' for k in range(j, i)])}) / l{i}{i})"

    kept = [c for c in models.columns if c[0] != "l"]
    return models.selectExpr(*kept, *(f"{inverse(i, j)} AS w{i}{j}" for i in _D for j in range(i + 1)), f"{_sum([f'2 * ln(l{i}{i})' for i in _D])} AS logdet")


def _squared_distance() -> Column:
    rows = [_sum([f"w{i}{j} * ({FEATURES[j]} - m{j})" for j in range(i + 1)]) for i in _D]
    return F.expr(_sum([f"power({y}, 2)" for y in rows]))


def _with(rows: DataFrame, groups: DataFrame, key: str, n: int) -> DataFrame:
    """Rows with their group's columns; ``n``: number of groups."""
    if n <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(groups), key)
    return rows.join(groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [key, "salt"])


def _kept(groups: DataFrame, n: int) -> DataFrame:
    """A table of ``n`` groups, computed once; one file where it is small enough to be broadcast."""
    return cut(groups.repartition(1) if n <= BROADCAST_GROUPS else groups)


def _moments(rows: DataFrame, factor: float, *keys: str) -> DataFrame:
    """Means, and covariances times ``factor`` plus the floor."""
    sums = rows.groupBy(*keys).agg(F.count("*").alias("k"), *(F.expr(f"sum({f}) AS s{i}") for i, f in enumerate(FEATURES)), *(F.expr(f"sum({FEATURES[i]} * {FEATURES[j]}) AS v{i}{j}") for i, j in _PAIRS))
    return sums.selectExpr(*keys, *(f"s{i} / k AS m{i}" for i in _D), *(f"(v{i}{j} / k - s{i} / k * s{j} / k) * {factor}D + {_floor(i, j)} AS c{i}{j}" for i, j in _PAIRS))


def _floor(i: int, j: int) -> str:
    return f"{FLOOR[i] ** 2 if i == j else 0.0}D"


def _starts(rows: DataFrame, n: int) -> DataFrame:
    """(grp, start, m, w): three first estimates a group around its medians."""
    sketch = lambda x, name: F.expr(f"percentile_approx({x}, 0.5, 2000) AS {name}")
    med = _kept(rows.groupBy("grp").agg(*(sketch(f, f"m{i}") for i, f in enumerate(FEATURES))), n)
    mad = _with(rows, med, "grp", n).groupBy("grp").agg(*(sketch(f"abs({f} - m{i})", f"a{i}") for i, f in enumerate(FEATURES)))
    base = _kept(med.join(mad, "grp").selectExpr("grp", *(f"m{i}" for i in _D), *(f"sqrt(power(a{i} * 1.4826D, 2) + {_floor(i, i)}) AS s{i}" for i in _D)), n)
    scored = _with(rows, base, "grp", n).selectExpr("grp", *(f"({f} - m{i}) / s{i} AS z{i}" for i, f in enumerate(FEATURES)))
    scored = scored.selectExpr("*", *(f"tanh(z{i}) AS t{i}" for i in _D), f"greatest({_sum([f'z{i} * z{i}' for i in _D])}, 1e-18D) AS zz")
    parts = scored.groupBy("grp").agg(*(F.expr(f"avg(t{i} * t{j}) AS t{i}{j}") for i, j in _PAIRS), *(F.expr(f"avg(z{i} * z{j} / zz) AS k{i}{j}") for i, j in _PAIRS))
    correlations = (lambda i, j: f"{float(i == j)}D", lambda i, j: f"t{i}{j}", lambda i, j: f"{len(FEATURES)} * k{i}{j}")
    structs = [f"named_struct({', '.join(f"""'c{i}{j}', {r(i, j)} * s{i} * s{j} + {_floor(i, j)}""" for i, j in _PAIRS)})" for r in correlations]
    long = base.join(parts, "grp").selectExpr("grp", *(f"m{i}" for i in _D), f"posexplode(array({', '.join(structs)})) AS (start, c)")
    return _kept(_factored(long.select("grp", "start", *(f"m{i}" for i in _D), "c.*")), n)


def _concentrated(rows: DataFrame, models: DataFrame, n: int, coverage: float) -> DataFrame:
    """The next estimates, from the ``coverage`` share of a group's rows that is nearest to each of ``models``."""
    near = _with(rows, models, "grp", n).select("grp", "start", _squared_distance().alias("d2"))
    edge = near.groupBy("grp", "start").agg(F.percentile_approx("d2", coverage, 2000).alias("edge"))
    inside = _with(rows, models.join(edge, ["grp", "start"]), "grp", n).filter(_squared_distance() <= F.col("edge"))
    return _kept(_factored(_moments(inside, _consistency(coverage), "grp", "start")), n)


def least_determinant(rows: DataFrame, coverage: float = 0.75, steps: int = 2, more: int = 1) -> DataFrame:
    """(grp, n, m, c): reweighted estimates of the groups of ``rows(grp, salt, x0..x3)``.

    ``steps``: concentration steps from each start; ``more``: further ones from the best.
    """
    sizes = cut(rows.groupBy("grp").agg(F.count("*").alias("n")))
    n = sizes.count()
    models = _starts(rows, n)
    for _ in range(steps):
        models = _concentrated(rows, models, n, coverage)
    best = F.min_by(F.struct(*(c for c in models.columns if c != "grp")), F.struct(F.round("logdet", 9), "start"))
    models = _kept(models.groupBy("grp").agg(best.alias("best")).select("grp", "best.*"), n)
    for _ in range(more):
        models = _concentrated(rows, models, n, coverage)
    inside = _with(rows, models, "grp", n).filter(_squared_distance() <= _quantile(REWEIGHT))
    found = _moments(inside, _consistency(REWEIGHT), "grp")
    moments = [f"m{i}" for i in _D] + [f"c{i}{j}" for i, j in _PAIRS]
    both = sizes.join(models.select("grp", F.struct(*moments).alias("first")), "grp").join(found.select("grp", F.struct(*moments).alias("then")), "grp", "left")
    return _kept(both.select("grp", "n", F.coalesce("then", "first").alias("e")).select("grp", "n", "e.*"), n)


def _blended(rows: DataFrame, own: str, other: str, keep: list[str]) -> DataFrame:
    """Moments of the mixture of two estimates (structs) by ``{own}_weight``, as ``own``: the gap of their means widens it."""
    w = f"{own}_weight"
    mean = [f"{w} * {own}.m{i} + (1 - {w}) * {other}.m{i} AS m{i}" for i in _D]
    gap = lambda i: f"({own}.m{i} - {other}.m{i})"
    cov = [f"{w} * {own}.c{i}{j} + (1 - {w}) * {other}.c{i}{j} + {w} * (1 - {w}) * {gap(i)} * {gap(j)} AS c{i}{j}" for i, j in _PAIRS]
    return rows.selectExpr(*keep, f"struct({', '.join(mean + cov)}) AS {own}")


def _shrunk(groups: DataFrame, models: DataFrame, shrink: float) -> DataFrame:
    """(grp, m, w) of ``groups(grp, lang_grp)``: their own estimates, the language's and that of all rows, by size."""
    moments = [f"m{i}" for i in _D] + [f"c{i}{j}" for i, j in _PAIRS]
    of = lambda grp, name: models.selectExpr(f"grp AS {grp}", f"n / (n + {shrink}D) AS {name}_weight", f"struct({', '.join(moments)}) AS {name}")
    rows = groups.withColumn("all_grp", F.pmod("lang_grp", F.lit(1)).cast("long")).join(of("grp", "own"), "grp").join(of("lang_grp", "lang"), "lang_grp").join(of("all_grp", "every"), "all_grp")
    rows = _blended(rows, "lang", "every", ["grp", "own", "own_weight"])
    return _factored(_blended(rows, "own", "lang", ["grp"]).select("grp", "own.*")).drop("logdet", *(f"c{i}{j}" for i, j in _PAIRS))


def group_of(lang: str = "lang", source: str = "source") -> Column:
    """Hash of the group, a language's documents of one source, by which a document is judged."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))
    return F.xxhash64(F.lit("source"), name(lang), name(source))


def judge(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, cutoff: float = CUTOFF, coverage: float = 0.75, shrink: float = 50) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance, text_hash, grp.

    ``distance`` is null for documents that fail the base rules.  ``shrink``: rows at which a group's own estimate and
    its language's weigh the same.
    """
    rows = statistics(docs)
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    name = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))
    group = {"grp": group_of(), "lang_grp": F.xxhash64(F.lit("lang"), name("lang")), "salt": F.pmod(F.xxhash64("text_hash", "doc_id"), F.lit(SALTS)).cast("int")}
    rows = rows.withColumn("base_failed", failed).withColumns(group)
    rows = cut(rows.select("*", *(v.alias(f) for f, v in zip(FEATURES, _vector(), strict=True))).drop("lang", "source", "n_lines"))
    good = rows.filter("not base_failed")
    # Vectors are small: tasks of many rows combine a group's sums before they are shuffled.
    packed = good.coalesce(max(LEAST_TASKS, rows.count() // ROWS_A_TASK))
    levels = packed.select(F.explode(F.array("grp", "lang_grp", F.lit(0).cast("long"))).alias("grp"), "salt", *FEATURES)
    models = least_determinant(levels, coverage)
    groups = cut(_shrunk(good.select("grp", "lang_grp").distinct(), models, shrink))
    far = _with(good, groups, "grp", groups.count()).withColumn("distance", F.sqrt(_squared_distance()))
    out = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    passed = far.select(*out, (F.col("distance") <= cutoff).alias("kept"), "distance", "text_hash", "grp")
    return passed.unionByName(rows.filter("base_failed").select(*out, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance"), "text_hash", "grp"))
