"""Keyed tables: reconciliation, validation reports, upserts, stale deletes and foreign-key effects."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_of(items: DataFrame, key: str, order: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The row with the smallest ``order`` of each key; a mergeable aggregate, no window."""
    columns = columns or [c for c in items.columns if c != key]
    return items.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("_r")).select(key, "_r.*")


def last_of(items: DataFrame, key: str, order: str, columns: Sequence[str] | None = None) -> DataFrame:
    columns = columns or [c for c in items.columns if c != key]
    return items.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_r")).select(key, "_r.*")


def grouped_items(items: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """All items of a key as one ordered array (``items``); meant for keys with few items, like a segment's keyframes."""
    return items.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("items"))


def reconcile(a: DataFrame, b: DataFrame, key: str, names: tuple[str, str] = ("missing_in_a", "missing_in_b")) -> DataFrame:
    """(key, side): keys that only one of two tables has."""
    x, y = a.select(F.col(key), F.lit(1).alias("_a")).distinct(), b.select(F.col(key), F.lit(1).alias("_b")).distinct()
    both = x.join(y, key, "full_outer").filter("_a is null or _b is null")
    return both.select(key, F.when(F.col("_a").isNull(), names[0]).otherwise(names[1]).alias("side"))


def require_reconciled(a: DataFrame, b: DataFrame, key: str) -> None:
    """Error with one example if any key is on one side only."""
    row = reconcile(a, b, key).first()
    if row is not None:
        raise ValueError(f"{key} {row[0]!r}: {row['side']}")


def disagreements(a: DataFrame, b: DataFrame, key: str, column: str) -> DataFrame:
    """Rows that both tables have under ``key`` but with different values of ``column``."""
    x, y = a.select(key, F.col(column).alias("value_a")), b.select(key, F.col(column).alias("value_b"))
    return x.join(y, key).filter(~F.col("value_a").eqNullSafe(F.col("value_b")))


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).count().filter("count > 1")


def without(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return rows.join(other.select(key), key, "left_anti").select(*rows.columns)


def only(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return rows.join(other.select(key), key, "left_semi").select(*rows.columns)


def cascade(tables: Mapping[str, DataFrame], links: Sequence[tuple[str, str, str]]) -> dict[str, DataFrame]:
    """Tables after cascading deletes: for each (child, parent, key), in order, children whose parent is gone go."""
    out = dict(tables)
    for child, parent, key in links:
        out[child] = only(out[child], out[parent], key)
    return out


def null_lost(rows: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``key`` set to null where the parent no longer has it."""
    there = parent.select(F.col(key).alias("_key")).distinct()
    return rows.join(there, F.col(key) == F.col("_key"), "left").withColumn(key, F.col("_key")).select(*rows.columns)


def unique_rows(rows: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """(_k, _n): one row a key as a struct; the last by ``order``, or an error where a key is repeated or null."""
    row = F.struct(*rows.columns)
    one = rows.groupBy(F.col(key).alias("_k")).agg((F.first(row) if order is None else F.max_by(row, order)).alias("_n"), F.count("*").alias("_m"))
    bad = F.when(F.col("_k").isNull(), F.raise_error(F.lit(f"a row without {key}")))
    if order is None:
        bad = bad.when(F.col("_m") > 1, F.raise_error(F.concat(F.lit(f"{key} is repeated: "), F.col("_k").cast("string"))))
    return one.select("_k", bad.otherwise(F.col("_n")).alias("_n"))


def upsert(old: DataFrame, new: DataFrame, key: str, update: Sequence[str], order: str | None = None) -> DataFrame:
    """Snapshot after an upsert: new keys are added, known ones take the ``update`` columns, all other columns stay.

    Of new rows under one key the last by ``order`` counts; without an order such rows fail the upsert, as do new rows
    without a key.  A column that only one side has is null in the other's rows; one that is new to the table is filled
    for known rows as well.
    """
    columns = [*old.columns, *(c for c in new.columns if c not in old.columns)]
    o = old.select(F.col(key).alias("_k"), F.struct(*old.columns).alias("_o"))
    n = unique_rows(new, key, order)
    both = o.join(n, "_k", "full_outer")

    def value(c: str) -> Column:
        was = F.col("_o")[c] if c in old.columns else F.lit(None)
        now = F.col("_n")[c] if c in new.columns else F.lit(None)
        if c == key:
            return F.col("_k").alias(c)
        if c in update or c not in old.columns:
            return F.when(F.col("_n").isNotNull(), now).otherwise(was).alias(c)
        return F.when(F.col("_o").isNotNull(), was).otherwise(now).alias(c)

    return both.select(*(value(c) for c in columns))


def replace_keys(earlier: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Earlier rows without those whose key appears anew, and the new rows."""
    return without(earlier, new, key).unionByName(new, allowMissingColumns=True)


def append(earlier: DataFrame, new: DataFrame) -> DataFrame:
    return earlier.unionByName(new, allowMissingColumns=True)


def evolved(rows: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """``rows`` with the columns (name -> type) that it lacks, as nulls."""
    return rows.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in rows.columns})


def cardinalities(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, rows) of several tables in one result."""
    counts = [t.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows") for n, t in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def errors_of(tests: Sequence[tuple[Column, str]]) -> Column:
    """Codes of the failed tests; a test that is null has failed."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for ok, code in tests)))


def error_report(rows: DataFrame, key: str, errors: Column) -> DataFrame:
    """(key, error): one row for each error."""
    return rows.select(key, F.explode(errors).alias("error"))


def error_total(report: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Number of errors, duplicated keys counted once each."""
    return report.agg(F.count("*").alias("n")).union(duplicates.agg(F.count("*").alias("n"))).agg(F.sum("n").alias("errors"))
