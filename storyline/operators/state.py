"""DML as pure functions: old state and changes in, next state out. Writers overwrite versions or day partitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def same(left: str, right: str, keys: list[str]) -> Column:
    """Null-safe equality of keys of two aliased frames."""
    return reduce(lambda a, b: a & b, (F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys))


def insert_absent(store: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """The store and those new rows whose key it lacks; of new rows with one key the first in order."""
    fresh = first_per_key(new, keys, order) if order else new.dropDuplicates(keys)
    absent = fresh.alias("n").join(store.select(*keys).alias("s"), same("n", "s", keys), "left_anti")
    return store.unionByName(absent, allowMissingColumns=True)


def upsert(store: DataFrame, new: DataFrame, keys: list[str], ignore_nulls: bool = True, fill_only: tuple[str, ...] = ()) -> DataFrame:
    """Updates rows by key and adds the others. Null values of ``new`` leave the old ones; ``fill_only`` columns change only where they were null."""
    joined = store.withColumn("__old", F.lit(True)).alias("s").join(new.alias("n"), same("s", "n", keys), "full_outer")

    def value(c: str) -> Column:
        if c not in new.columns:
            return F.col(f"s.{c}").alias(c)
        old, got = F.col(f"s.{c}"), F.col(f"n.{c}")
        if c in keys or c in fill_only:
            return F.coalesce(old, got).alias(c)
        return (F.coalesce(got, old) if ignore_nulls else F.when(F.col("n." + keys[0]).isNull() & F.col("__old").isNotNull(), old).otherwise(got)).alias(c)

    return joined.select(*(value(c) for c in store.columns))


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def merge_bank(bank: DataFrame, new: DataFrame, key: str, stamp: str) -> DataFrame:
    """A bank of records and a new list: keys are unique, the latest stamp wins and the bank's row on a tie; null keys go."""
    both = bank.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True).where(F.col(key).isNotNull())
    return first_per_key(both, [key], [F.coalesce(F.col(stamp), F.lit("1900-01-01T00:00:00")).desc(), F.col("__new")]).drop("__new")


def id_map(source: DataFrame, target: DataFrame, keys: list[str], source_id: str, target_id: str) -> DataFrame:
    """(source_id, target_id) of rows that share a natural key."""
    left = source.select(F.col(source_id).alias("source_id"), *keys).alias("a")
    right = target.groupBy(*keys).agg(F.min(target_id).alias("target_id")).alias("b")
    return left.join(right, same("a", "b", keys)).select("source_id", "target_id")


def remap(rows: DataFrame, mapping: DataFrame, column: str, keep_unmapped: bool = False) -> DataFrame:
    """Translates a foreign key; rows without a translation go, or keep a null key."""
    how = "left" if keep_unmapped else "inner"
    return rows.join(mapping, rows[column] == mapping["source_id"], how).drop(column, "source_id").withColumnRenamed("target_id", column).select(*rows.columns)


def changed_since(rows: DataFrame, since: Column, *stamps: str) -> DataFrame:
    return rows.where(reduce(lambda a, b: a | b, (F.col(s) > since for s in stamps)))


def high_water_mark(rows: DataFrame, *stamps: str) -> DataFrame:
    return rows.agg(F.max(F.greatest(*(F.col(s) for s in stamps)) if len(stamps) > 1 else F.col(stamps[0])).alias("high_water_mark"))


def replicate(source: DataFrame, target: DataFrame, keys: list[str], since: Column, stamps: tuple[str, ...], fill_only: tuple[str, ...] = (), update: bool = True) -> DataFrame:
    """The target after an incremental copy of what changed in the source."""
    changed = changed_since(source, since, *stamps)
    return upsert(target, changed, keys, fill_only=fill_only) if update else insert_absent(target, changed, keys)


def replace_days(old: DataFrame, new: DataFrame, stamp: str) -> DataFrame:
    """Partition replace: days that ``new`` holds are taken from it, the others stay."""
    days = new.select(F.to_date(stamp).alias("__day")).distinct()
    kept = old.withColumn("__day", F.to_date(stamp)).join(F.broadcast(days), "__day", "left_anti").drop("__day")
    return kept.unionByName(new)


def retain(rows: DataFrame, stamp: str, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, expired)."""
    return rows.where(F.col(stamp) >= cutoff), rows.where(F.col(stamp) < cutoff)


def cascade_delete(children: DataFrame, gone: DataFrame, child_key: str, key: str) -> DataFrame:
    return children.join(gone.select(F.col(key).alias(child_key)).distinct(), child_key, "left_anti")


def referenced(rows: DataFrame, key: str, *references: tuple[DataFrame, str]) -> DataFrame:
    """Rows that any of the reference columns names: one semi join with their union instead of OR-ed EXISTS."""
    ids = reduce(DataFrame.union, (f.select(F.col(c).alias("__id")) for f, c in references)).where("__id is not null").distinct()
    return rows.join(ids, rows[key] == ids["__id"], "left_semi")


def compact(rows: DataFrame, when: Column, empty: tuple[str, ...] = (), null: tuple[str, ...] = ()) -> DataFrame:
    """Blanks the heavy columns of rows that must stay."""
    return rows.withColumns({c: F.when(when, F.lit("")).otherwise(F.col(c)) for c in empty} | {c: F.when(~when, F.col(c)) for c in null})


def audited_update(state: DataFrame, changes: DataFrame, key: str, column: str, now: Column, user: str = "system") -> tuple[DataFrame, DataFrame]:
    """``changes``: key, value, reason. Next state, and an audit row a change with the old and new value."""
    new = changes.select(F.col(key), F.col("value").alias("__value"), F.col("reason").alias("__reason"))
    joined = state.join(new, key, "left")
    following = joined.withColumn(column, F.coalesce("__value", column)).select(*state.columns)
    audit = joined.where("__value is not null").select(
        F.col(key), F.lit(column).alias("field"), F.col(column).cast("string").alias("old_value"), F.col("__value").cast("string").alias("new_value"),
        F.col("__reason").alias("reason"), F.lit(user).alias("changed_by"), now.alias("changed_at"),
    )
    return following, audit


def mark(rows: DataFrame, ids: DataFrame, key: str, column: str, value: Column) -> DataFrame:
    hit = ids.select(F.col(key), F.lit(True).alias("__hit")).distinct()
    return rows.join(hit, key, "left").withColumn(column, F.when(F.col("__hit"), value).otherwise(F.col(column))).drop("__hit").select(*rows.columns)


def merge_groups(groups: DataFrame, members: DataFrame, mapping: DataFrame, group_key: str, member_group: str) -> tuple[DataFrame, DataFrame]:
    """Moves the members of ``mapping.source`` groups to ``mapping.target``, discards the emptied groups and recounts."""
    m = mapping.select(F.col("source").alias("__source"), F.col("target").alias("__target"))
    moved = members.join(m, members[member_group] == m["__source"], "left").withColumn(member_group, F.coalesce("__target", member_group)).select(*members.columns)
    counts = moved.groupBy(F.col(member_group).alias("__group")).agg(F.count("*").alias("n_members"))
    out = groups.join(m, groups[group_key] == m["__source"], "left").join(counts, groups[group_key] == F.col("__group"), "left")
    return out.select(*groups.columns, F.coalesce("n_members", F.lit(0)).alias("n_members"), F.col("__target").isNotNull().alias("discarded")), moved


def clear_range(rows: DataFrame, stamp: str | None = None, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """What is left after a ranged delete: rows from ``start`` to a day after ``end`` go, both included; without a range all go."""
    if stamp is None or start is None or end is None:
        return rows.limit(0)
    inside = F.col(stamp).between(start, end + F.expr("INTERVAL 1 DAY"))
    return rows.where(~F.coalesce(inside, F.lit(False)))


def log_rows(events: DataFrame, level: Column, component: Column, message: Column, now: Column, details: Column | None = None) -> DataFrame:
    """Log rows, one an event, for appending; ``article_id`` and ``cluster_id`` are null where events lack them."""
    ids = [F.col(c) if c in events.columns else F.lit(None).cast("long").alias(c) for c in ("article_id", "cluster_id")]
    return events.select(level.alias("level"), component.alias("component"), message.alias("message"), (F.lit("{}") if details is None else F.coalesce(details, F.lit("{}"))).alias("details"), *ids, now.alias("created_at"))


def already_sent(logs: DataFrame, day: Column, component: str = "broadcaster") -> DataFrame:
    """One row: whether the log holds a success of the component on the day."""
    hit = (F.col("component") == component) & (F.col("level") == "INFO") & (F.to_date("created_at") == day)
    return logs.where(hit).agg((F.count("*") > 0).alias("sent"))


def write_days(rows: DataFrame, path: str, stamp: str) -> None:
    """Writes rows by day; days that ``rows`` holds are replaced in the folder, the others stay."""
    days = rows.withColumn("day", F.to_date(stamp))
    days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
