"""Replication and retention over related tables: a declared graph of natural keys, foreign keys and time stamps.

Tables are handled in the order of their foreign keys, so that ids are known before rows that refer to them are copied,
and references before rows that they hold. Every step is joins of whole tables by key; results are written to the
shared folder a table at a time, which cuts the lineage.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyline.operators import state as S
from storyline.shared import shared_path


@dataclass(frozen=True)
class Table:
    """A table of the graph. ``keys``: its natural key, the same in every store; foreign keys may be part of it. ``id``: its own
    number, which differs between stores. ``refers``: column -> name of the table whose id it holds. ``stamps``: when a row was
    made or changed. ``mode``: what a row does that is there already, ``update`` (values that are not null replace the old
    ones), ``fill`` (only what is null is filled) or ``insert`` (nothing)."""

    name: str
    keys: tuple[str, ...]
    id: str | None = None
    refers: Mapping[str, str] = field(default_factory=dict)
    stamps: tuple[str, ...] = ()
    mode: str = "update"

    def __post_init__(self) -> None:
        if self.mode not in ("update", "fill", "insert"):
            raise ValueError(f"{self.name}: unknown mode {self.mode}")


def in_order(tables: Iterable[Table]) -> list[Table]:
    """The tables, each after those that it refers to; a circle or an unknown table is an error. A table may refer to itself only in no order, so it may not."""
    left, out = {t.name: t for t in tables}, []
    names = set(left)
    for t in left.values():
        if unknown := set(t.refers.values()) - names:
            raise ValueError(f"{t.name} refers to unknown tables: {sorted(unknown)}")
    while left:
        ready = [t for t in left.values() if not set(t.refers.values()) & set(left)]
        if not ready:
            raise ValueError(f"tables refer to one another in a circle: {sorted(left)}")
        out += ready
        for t in ready:
            del left[t.name]
    return out


def _written(df: DataFrame, tag: str) -> DataFrame:
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _translated(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows with a foreign key in the target's ids; a null stays null, a row whose id has no translation goes."""
    named = ids.select(F.col("source_id").alias("__from"), F.col("target_id").alias("__to"))
    joined = rows.join(named, rows[column] == named["__from"], "left")
    return joined.where(F.col(column).isNull() | F.col("__to").isNotNull()).withColumn(column, F.col("__to")).select(*rows.columns)


def replicate(tables: Iterable[Table], source: Mapping[str, DataFrame], target: Mapping[str, DataFrame], since: Mapping[str, Column | None] | None = None) -> dict[str, DataFrame]:
    """The target's tables after a copy of what changed in the source's: rows stamped after ``since`` of the table (all rows where it
    has none), each found by its natural key or added. A new row's id is its old one, moved past the target's greatest. Of
    source rows with one natural key the least id counts, and references to the others follow it. A copy that runs again
    changes nothing."""
    ids: dict[str, DataFrame] = {}
    out: dict[str, DataFrame] = {}
    for t in in_order(tables):
        own, store = source[t.name], target[t.name]
        for column, parent in t.refers.items():
            own = _translated(own, column, ids[parent])
        mark = (since or {}).get(t.name)
        changed = own if mark is None or not t.stamps else S.changed_since(own, mark, *t.stamps)
        changed = S.first_per_key(changed, list(t.keys), [F.col(t.id)] if t.id else [F.col(c) for c in own.columns])
        if t.id:
            absent = changed.alias("n").join(store.select(*t.keys).alias("s"), S.same("n", "s", list(t.keys)), "left_anti")
            move = F.coalesce(F.max("__most"), F.lit(0)) + 1 - F.coalesce(F.min("__least"), F.lit(0))
            ends = store.agg(F.max(t.id).alias("__most")).select("__most", F.lit(None).cast("long").alias("__least")).union(absent.agg(F.min(t.id).alias("__least")).select(F.lit(None).cast("long"), "__least"))
            moved = ends.agg(move.alias("by")).first()["by"]
            changed = changed.withColumn(t.id, (F.col(t.id) + F.lit(moved)).cast(own.schema[t.id].dataType))
        keep = tuple(c for c in store.columns if t.mode == "fill" or c == t.id)
        following = S.insert_absent(store, changed, list(t.keys)) if t.mode == "insert" else S.upsert(store, changed, list(t.keys), fill_only=keep)
        out[t.name] = _written(following, f"replicated-{t.name}")
        if t.id:
            ids[t.name] = _written(S.id_map(own, out[t.name], list(t.keys), t.id, t.id), f"ids-{t.name}")
    return out


def marks(tables: Iterable[Table], source: Mapping[str, DataFrame]) -> DataFrame:
    """(table, high_water_mark): the newest stamp of each table that has stamps, for the next copy."""
    rows = [S.high_water_mark(source[t.name], *t.stamps).select(F.lit(t.name).alias("table"), "high_water_mark") for t in tables if t.stamps]
    return reduce(DataFrame.union, rows)


def retain(tables: Iterable[Table], frames: Mapping[str, DataFrame], cutoff: Column) -> dict[str, DataFrame]:
    """Each table with ``part``: ``hot`` rows are stamped at the cutoff or later, ``held`` ones are older (or have no stamp) but a row
    that stays refers to them, directly or over other rows, and ``cold`` ones may go. Tables without stamps are only held."""
    order = in_order(tables)
    out: dict[str, DataFrame] = {}
    wanted: dict[str, list[DataFrame]] = {t.name: [] for t in order}
    for t in reversed(order):
        rows = frames[t.name]
        fresh = F.coalesce(reduce(lambda a, b: a | b, (F.col(s) >= cutoff for s in t.stamps)), F.lit(False)) if t.stamps else F.lit(False)
        if t.id and wanted[t.name]:
            asked = reduce(DataFrame.union, wanted[t.name]).where("__id is not null").distinct().withColumn("__held", F.lit(True))
            rows = rows.join(asked, rows[t.id] == asked["__id"], "left").drop("__id")
        else:
            rows = rows.withColumn("__held", F.lit(None).cast("boolean"))
        marked = _written(rows.withColumn("part", F.when(fresh, "hot").when(F.col("__held"), "held").otherwise("cold")).drop("__held"), f"retained-{t.name}")
        out[t.name] = marked
        for column, parent in t.refers.items():
            wanted[parent].append(marked.where("part <> 'cold'").select(F.col(column).alias("__id")))
    return {t.name: out[t.name] for t in order}


def archive(marked: DataFrame, stamp: str, path: str) -> None:
    """The cold rows of a table, a folder a day; days that are written again replace themselves."""
    cold = marked.where("part = 'cold'").drop("part").withColumn("day", F.coalesce(F.to_date(stamp).cast("string"), F.lit("none")))
    cold.write.mode("overwrite").partitionBy("day").option("partitionOverwriteMode", "dynamic").parquet(path)
