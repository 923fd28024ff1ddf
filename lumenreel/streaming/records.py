"""Record-level runs: a function of one record runs in tasks, and one record's failure stays that record's."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

COMPLETED, FAILED = "completed", "failed"
#: Longest error text that is kept.
ERROR_CHARS = 1000
STATUS = (StructField("status", StringType()), StructField("attempts", IntegerType()), StructField("error", StringType()))


def _fits(value: Any, kind: pa.DataType) -> bool:
    """Whether a value surely has an Arrow form; what is not seen at once is left to Arrow, which takes longer."""
    if value is None:
        return True
    of = type(value)
    return of is float and pa.types.is_float64(kind) or of is int and pa.types.is_int64(kind) and -(1 << 63) <= value < 1 << 63 or of is bool and pa.types.is_boolean(kind) or of is str and pa.types.is_string(kind) and value.isascii()


def _typed(value: Mapping[str, Any], kinds: dict[str, pa.DataType]) -> dict[str, Any]:
    """A result that has nothing but columns of the schema, with values that fit; errors otherwise."""
    extra = value.keys() - kinds.keys()
    if extra:
        raise ValueError(f"the result has unknown columns: {', '.join(sorted(extra))}")
    for name, kind in kinds.items():
        if not _fits(value.get(name), kind):
            pa.array([value[name]], kind)
    return dict(value)


def isolated(records: DataFrame, function: Callable[[dict[str, Any]], Mapping[str, Any]], schema: str, retries: int = 1, batch: int = 1000) -> DataFrame:
    """One row per record: its columns, ``status``, ``attempts``, ``error``, and the columns of ``schema``.

    ``function`` gets a record as a dict and returns a dict of the result's columns; what it lacks is null.  If it raises,
    or returns what does not fit the schema, the record is tried again up to ``retries`` times, then it is ``failed``, with
    the last error's type and text and null results.  Other records are not touched: nothing is raised, and a task that is
    run again after an executor was lost gives the same rows.  Results of names that records have replace them.
    """
    probe = records.sparkSession.createDataFrame([], schema)
    own = [f for f in records.schema if f.name not in probe.columns and f.name not in {s.name for s in STATUS}]
    out = StructType([*own, *STATUS, *probe.schema])
    kinds, results = to_arrow_schema(out), {f.name: f.type for f in to_arrow_schema(probe.schema)}
    names = [f.name for f in own]

    def attempt(record: dict[str, Any]) -> dict[str, Any]:
        error = ""
        for n in range(1, retries + 2):
            try:
                return _typed(function(dict(record)), results) | {"status": COMPLETED, "attempts": n, "error": None}
            except Exception as e:  # noqa: BLE001  whatever a user's function raises is the record's result
                error = f"{type(e).__name__}: {e}"[:ERROR_CHARS]
        return {"status": FAILED, "attempts": retries + 1, "error": error}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                done = [attempt(r) for r in part.to_pylist()]
                columns = [part.column(c) for c in names] + [pa.array([d.get(f.name) for d in done], f.type) for f in list(kinds)[len(names) :]]
                yield pa.RecordBatch.from_arrays(columns, kinds.names)

    return records.mapInArrow(run, out)


def failed(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("status") == FAILED)


def not_failed(rows: DataFrame) -> DataFrame:
    return rows.filter(F.coalesce(F.col("status"), F.lit(COMPLETED)) != FAILED)
