"""Ordered key-value operators: batches of changes over an immutable table, both as DataFrames.

A change is (key, value, is_delete, seq); the largest ``seq`` of a key wins. All operators are equi-joins on
the key and keep whatever types key and value have. Null keys are no keys: changes with one are dropped.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SPAN = 1024


def upserts(df: DataFrame, seq: Column | None = None) -> DataFrame:
    return df.select("key", "value", F.lit(False).alias("is_delete"), (F.lit(0) if seq is None else seq).cast("bigint").alias("seq"))


def deletes(keys: DataFrame, value_type: str, seq: Column | None = None) -> DataFrame:
    return keys.select("key", F.lit(None).cast(value_type).alias("value"), F.lit(True).alias("is_delete"), (F.lit(0) if seq is None else seq).cast("bigint").alias("seq"))


def last_wins(changes: DataFrame) -> DataFrame:
    """One change for each key, that of the largest seq; of equal ones an upsert, of these the largest value."""
    best = F.max_by(F.struct("value", "is_delete"), F.struct("seq", ~F.col("is_delete"), "value"))
    return changes.where("key IS NOT NULL").groupBy("key").agg(best.alias("c")).select("key", "c.value", "c.is_delete")


def overlay(current: DataFrame, changes: DataFrame) -> DataFrame:
    """The table after ``changes`` (key, value, is_delete), at most one of each key."""
    kept = current.select("key", "value").join(changes, "key", "left_anti")
    return kept.unionByName(changes.where("NOT is_delete").select("key", "value"))


def apply_changes(current: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the table after the changes, the deletes whose key was absent)."""
    final = last_wins(changes)
    return overlay(current, final), final.where("is_delete").select("key").join(current, "key", "left_anti")


def insert(current: DataFrame, rows: DataFrame) -> DataFrame:
    """Upserts; rows that repeat a key must not differ in order-free input: the largest value wins."""
    return overlay(current, last_wins(upserts(rows)))


def update(current: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the table with those of ``rows`` whose key is present, (key, updated))."""
    here = rows.join(current.select("key", F.lit(True).alias("updated")), "key", "left")
    return insert(current, here.where("updated").select("key", "value")), here.select("key", F.coalesce("updated", F.lit(False)).alias("updated"))


def delete(current: DataFrame, keys: DataFrame) -> DataFrame:
    """Without ``keys``; absent ones are ignored."""
    return current.join(keys.select("key"), "key", "left_anti").select("key", "value")


def status(current: DataFrame, changes: DataFrame) -> DataFrame:
    """(key, status) of staged changes: added, modified (the key is in the table) or deleted."""
    there = current.select("key", F.lit(True).alias("there"))
    kind = F.when(F.col("is_delete"), "deleted").when(F.col("there"), "modified").otherwise("added")
    return last_wins(changes).join(there, "key", "left").select("key", kind.alias("status"))


def list_keys(current: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """Sorted keys of the table under staged changes."""
    return (current if changes is None else overlay(current, last_wins(changes))).select("key").orderBy("key")


def scan(current: DataFrame, low=None, high=None, prefix: str | None = None) -> DataFrame:
    """Entries in key order with low <= key < high, or of a text prefix."""
    out = current
    for bound, op in ((low, "__ge__"), (high, "__lt__")):
        if bound is not None:
            out = out.where(getattr(F.col("key"), op)(F.lit(bound)))
    if prefix is not None:
        out = out.where(F.col("key").startswith(prefix))
    return out.orderBy("key")


def get(current: DataFrame, key) -> DataFrame:
    """The entry of one key, pushed down to the scan."""
    return current.where(F.col("key") == F.lit(key))


def free_ids(used: DataFrame, n: int, column: str = "id") -> DataFrame:
    """The ``n`` smallest integers from 0 that ``used`` lacks, in a few jobs however dense the ids are.

    Ids are counted by blocks of ``SPAN``; the first block before whose end n ids are free bounds the search.
    """
    ids = used.select(F.col(column).cast("bigint").alias("id")).where("id >= 0").distinct()
    per = ids.groupBy(F.expr(f"id div {SPAN}").alias("block")).agg(F.count("*").alias("used"))
    full = per.where(F.col("used") == SPAN).select("block")
    spark = used.sparkSession
    blocks = full.count() + n  # among so many, n blocks have a free id each
    gaps = spark.range(blocks).toDF("block").join(per, "block", "left").select("block", (F.lit(SPAN) - F.coalesce("used", F.lit(0))).alias("free")).where("free > 0")
    before = F.coalesce(F.sum("free").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    wanted = gaps.orderBy("block").limit(n).withColumn("before", before).where(F.col("before") < n).select("block")
    candidates = wanted.select(F.explode(F.sequence(F.col("block") * SPAN, F.col("block") * SPAN + (SPAN - 1))).alias("id"))
    return candidates.join(ids, "id", "left_anti").orderBy("id").limit(n)
