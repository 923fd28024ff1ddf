"""A store of keyed tables as parquet snapshots with one pointer.

A load writes every table that it changes to a folder of its own and then publishes all of them at once by writing one small
pointer, which names each table's folder, under the next version's number, so readers see either the old or the new tables.  A pointer is never overwritten: of two loads
that started from one version the second fails, and what it wrote is read by nobody.  Files are only written and listed by
Spark.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenreel.operators import tables as T
from lumenreel.operators.segments import with_places
from lumenreel.sources.folders import kept
from lumenreel.sources.io import exists

#: Columns that an upsert refreshes, by table; all others (creation stamps, a spot's id) keep their first value.
UPDATES: dict[str, tuple[str, ...]] = {
    "spots": ("spot_name", "region", "address", "latitude", "longitude", "description", "source_url"),
    "videos": ("title", "description", "video_path", "language"),
    "video_segments": ("video_id", "spot_id", "place_id", "start_time", "end_time", "caption", "summary", "tags", "mood_tags", "season_tags", "region", "drama_title", "spot_name", "place_name", "keyframe_path", "description", "metadata"),
    "segment_embeddings": ("text_embedding", "created_at"),
    "segment_keyframes": ("segment_id", "keyframe_path", "description", "time_of_day", "mood", "activity", "scene_elements", "metadata"),
    "keyframe_embeddings": ("image_embedding", "created_at"),
}
KEYS = {"spots": "place_id", "videos": "video_id", "video_segments": "segment_id", "segment_embeddings": "segment_id", "segment_keyframes": "keyframe_id", "keyframe_embeddings": "keyframe_id"}
#: Tables whose rows a load replaces as a whole, so that it must bring them.
REQUIRED = ("video_segments", "segment_keyframes")
#: (child, parent, key): children go with their parents.
CASCADES: Sequence[tuple[str, str, str]] = (("video_segments", "videos", "video_id"), ("segment_embeddings", "video_segments", "segment_id"), ("segment_keyframes", "video_segments", "segment_id"), ("keyframe_embeddings", "segment_keyframes", "keyframe_id"))


class VersionTaken(RuntimeError):
    """Another load has published a version since this one started."""


def _pointers(spark: SparkSession, root: str) -> DataFrame | None:
    return spark.read.schema("version long, folders map<string,string>").json(f"{root}/published/*") if exists(spark, f"{root}/published") else None


def version(spark: SparkSession, root: str) -> int:
    """Number of the published version; 0 if there is none."""
    pointers = _pointers(spark, root)
    return (pointers.agg(F.max("version")).first()[0] or 0) if pointers is not None else 0


def read(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    folders = _folders(spark, root)
    return {t: spark.read.parquet(f"{root}/{folders[t]}/{t}") for t in KEYS if t in folders}


def _folders(spark: SparkSession, root: str) -> dict[str, str]:
    """The folder of each table of the published version."""
    pointers = _pointers(spark, root)
    newest = pointers.orderBy(F.desc("version")).first() if pointers is not None else None
    return newest.folders or {} if newest else {}


def publish(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], after: int | None = None, same: Sequence[str] = (), check: Callable[[Mapping[str, DataFrame]], None] = lambda written: None) -> int:
    """Write all tables, then the pointer to them as the version behind ``after`` (by default the newest one).

    Tables named by ``same`` stay in the files where the published version has them.  ``check`` gets the written tables and
    may raise, in which case nothing is published.
    """
    v = (version(spark, root) if after is None else after) + 1
    folder = f"v{v}-{uuid.uuid4().hex}"
    before = _folders(spark, root) if same else {}
    folders = {t: before[t] for t in same} | dict.fromkeys(tables, folder)
    for name, rows in tables.items():
        rows.write.parquet(f"{root}/{folder}/{name}")
    check({t: spark.read.parquet(f"{root}/{folder}/{t}") for t in tables})
    if version(spark, root) >= v:
        raise VersionTaken(f"version {v} is there already")
    try:
        spark.createDataFrame([(v, folders)], "version long, folders map<string,string>").coalesce(1).write.mode("error").json(f"{root}/published/{v}")
    except AnalysisException as e:
        raise VersionTaken(f"version {v} is there already") from e
    return v


def stale_deleted(old: Mapping[str, DataFrame], new: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Old tables without keyframes and segments that are not in the new ones, and without what hung on them."""
    out = dict(old)
    if "segment_keyframes" in out:
        out["segment_keyframes"] = T.only(out["segment_keyframes"], new["segment_keyframes"], "keyframe_id")
    if "video_segments" in out:
        out["video_segments"] = T.only(out["video_segments"], new["video_segments"], "segment_id")
    return T.cascade(out, _links(out, CASCADES[1:]))


def _links(tables: Mapping[str, DataFrame], links: Sequence[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    return [x for x in links if x[0] in tables and x[1] in tables]


def deleted(tables: Mapping[str, DataFrame], table: str, gone: DataFrame) -> dict[str, DataFrame]:
    """Tables without the rows of ``table`` whose keys are in ``gone``: what hangs on them goes, a lost spot becomes null."""
    out = dict(tables) | {table: T.without(tables[table], gone.select(KEYS[table]), KEYS[table])}
    if table == "spots" and "video_segments" in out:
        out["video_segments"] = T.null_lost(out["video_segments"], out["spots"], "spot_id")
    return T.cascade(out, _below(out, table))


def _below(tables: Mapping[str, DataFrame], table: str) -> list[tuple[str, str, str]]:
    """The links by which rows of other tables hang on rows of ``table``, directly or not."""
    found, links = {table}, []
    for x in _links(tables, CASCADES):
        if x[1] in found:
            found.add(x[0])
            links.append(x)
    return links


def delete(spark: SparkSession, root: str, table: str, gone: DataFrame) -> int:
    """Publish the store without some rows of one table, with the effects on the others."""
    start = version(spark, root)
    old = read(spark, root)
    new = deleted(old, table, gone)
    return publish(spark, root, {t: rows for t, rows in new.items() if rows is not old[t]}, start, [t for t, rows in new.items() if rows is old[t]])


def load(spark: SparkSession, root: str, new: Mapping[str, DataFrame]) -> int:
    """Stale delete, then upsert, then one publication.

    ``new`` needs the tables in REQUIRED.  Where there are spots, segments take the ``spot_id`` of their place.  A key
    that a table brings twice, or a keyframe path under two ids, fails the load.
    """
    lacking = [t for t in REQUIRED if t not in new]
    if lacking:
        raise ValueError(f"a load needs the tables {', '.join(lacking)}")
    start = version(spark, root)
    old = stale_deleted(read(spark, root), new)
    out = {t: T.upsert(old[t], rows, KEYS[t], UPDATES[t]) if t in old else T.unique_rows(rows, KEYS[t]).select("_n.*") for t, rows in new.items()}
    out |= {t: rows for t, rows in old.items() if t not in out}
    if "spots" in out and "place_id" in out["video_segments"].columns:
        out["spots"] = kept(out["spots"])
        out["video_segments"] = with_places(out["video_segments"].drop("spot_id"), out["spots"])

    def check(written: Mapping[str, DataFrame]) -> None:
        if not T.duplicate_keys(written["segment_keyframes"], "keyframe_path").isEmpty():
            raise ValueError("a keyframe path has two ids")

    return publish(spark, root, out, start, check=check)
