"""Small relational helpers that most operators are built from."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.sources.files import stored


def latest_by(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order; ties are broken by the order alone, so make it total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def numbered(rows: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """Rows numbered from 1 within each key in an order, however many rows a key has.

    Rows are dealt out by ranges of key and order and stored, so that the ranges stay as they are; each range numbers its
    own, and starts where the ones before it end. A window over a whole key would be one task's.
    """
    laid = stored(rows.repartitionByRange(key, order).withColumn("_range", F.spark_partition_id()))
    sizes = laid.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    begins = sizes.select(key, "_range", F.coalesce(before, F.lit(0)).alias("_before"))
    own = laid.withColumn("_own", F.row_number().over(Window.partitionBy(key, "_range").orderBy(order)))
    return own.join(begins, [key, "_range"]).withColumn(name, F.col("_before") + F.col("_own")).drop("_range", "_own", "_before")


def sorted_list(by: Iterable[str], *fields: str) -> Column:
    """An aggregate: the fields of a group's rows as structs, ordered by ``by``."""
    by = list(by)
    # Not array_sort, which calls a comparator for each pair; no row is null, so the order is the same.
    rows = F.sort_array(F.collect_list(F.struct(*(F.col(b).alias(f"_{i}") for i, b in enumerate(by)), *fields)))
    return F.transform(rows, lambda r: F.struct(*(r[f].alias(f) for f in fields)))


def joined(by: Iterable[str], value: Column, sep: str = "|") -> Column:
    """An aggregate: a text of each row of the group, ordered by ``by`` and then by itself, with a separator between."""
    by = list(by)
    rows = F.sort_array(F.collect_list(F.struct(*(F.col(b).alias(f"_{i}") for i, b in enumerate(by)), value.cast("string").alias("v"))))
    return F.array_join(F.transform(rows, lambda r: r["v"]), sep)


def unambiguous(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key no other row claims; two claimants both go."""
    w = Window.partitionBy(*keys)
    return df.withColumn("_n", F.count(F.lit(1)).over(w)).where("_n = 1").drop("_n")


def duplicate_groups(df: DataFrame, *, id_col: str, key: Column, newest: Sequence[str]) -> DataFrame:
    """``canonical_id`` and ``members`` of each group of equal keys; the newest row names the group."""
    return df.withColumn("_key", key).groupBy("_key").agg(F.max_by(id_col, F.struct(*newest)).alias("canonical_id"), F.array_sort(F.collect_list(id_col)).alias("members")).drop("_key")


def merged(old: DataFrame, new: DataFrame, keys: Sequence[str], rules: dict[str, Column]) -> DataFrame:
    """A keyed upsert as a new snapshot: full outer join of ``o.*`` and ``n.*``, each column by its own rule.

    Rules see the columns of either side as ``o_<name>`` and ``n_<name>``, and ``in_old`` and ``in_new``.
    """
    o = old.select(*keys, *(F.col(c).alias(f"o_{c}") for c in old.columns if c not in keys), F.lit(True).alias("in_old"))
    n = new.select(*keys, *(F.col(c).alias(f"n_{c}") for c in new.columns if c not in keys), F.lit(True).alias("in_new"))
    both = o.join(n, list(keys), "full_outer").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("in_old", "in_new")})
    return both.select(*keys, *(rule.alias(name) for name, rule in rules.items()))


def newer(name: str) -> Column:
    """The new value where the row is in the new snapshot, even if null."""
    return F.when(F.col("in_new"), F.col(f"n_{name}")).otherwise(F.col(f"o_{name}"))


def replaced(old: DataFrame, new: DataFrame, parent: Sequence[str]) -> DataFrame:
    """All old children of the parents that have new ones make way for them."""
    return old.join(new.select(*parent).distinct(), list(parent), "left_anti").select(*old.columns).unionByName(new)


def gaps(df: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """Numbers missing from 1 to a group's largest, one row each."""
    seen = df.groupBy(*keys).agg(F.array_distinct(F.collect_list(number)).alias("_seen"), F.max(number).alias("_max"))
    missing = F.array_except(F.sequence(F.lit(1).cast(df.schema[number].dataType), F.col("_max")), F.col("_seen"))
    return seen.where("_max >= 1").select(*keys, F.explode(missing).alias(number))


def islands(df: DataFrame, keys: Sequence[str], begin: str, end: str, gap: float) -> DataFrame:
    """Intervals of a key that overlap or lie at most ``gap`` apart, merged."""
    w = Window.partitionBy(*keys).orderBy(begin, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = df.withColumn("_new", F.coalesce((F.col(begin) - before > gap).cast("int"), F.lit(0)))
    return opened.withColumn("_island", F.sum("_new").over(w)).groupBy(*keys, "_island").agg(F.min(begin).alias(begin), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("_island")


def flagged(condition: Column, name: str) -> Column:
    """The name where the condition holds, for arrays of problems."""
    return F.when(condition, F.lit(name))


def problems(*found: Column) -> Column:
    return F.filter(F.array(*found), lambda x: x.isNotNull())
