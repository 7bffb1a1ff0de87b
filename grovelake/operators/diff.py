"""Row-level difference of two versions, its inverse, and the history of keys."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def diff(old: DataFrame, new: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """(key, op, old, new) with op added, removed or modified: one full outer join on the key."""
    a = old.select(F.col(key).alias("key"), F.col(value).alias("old"), F.lit(True).alias("in_old"))
    b = new.select(F.col(key).alias("key"), F.col(value).alias("new"), F.lit(True).alias("in_new"))
    both = a.join(b, "key", "full_outer")
    op = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "modified")
    return both.withColumn("op", op).where("op IS NOT NULL").select("key", "op", "old", "new")


def inverse(changes: DataFrame) -> DataFrame:
    """The difference the other way round."""
    op = F.when(F.col("op") == "added", "removed").when(F.col("op") == "removed", "added").otherwise("modified")
    return changes.select("key", op.alias("op"), F.col("new").alias("old"), F.col("old").alias("new"))


def patch(current: DataFrame, changes: DataFrame) -> DataFrame:
    """``current`` with a difference applied."""
    kept = current.select("key", "value").join(changes.select("key"), "key", "left_anti")
    return kept.unionByName(changes.where("op <> 'removed'").select("key", F.col("new").alias("value")))


def key_history(versions: DataFrame, order: list[str]) -> DataFrame:
    """Of (key, value, is_delete, order columns) the rows where the key's value differs from before, with ``previous``.

    A deletion and a key that comes again are changes; the first row of a key is one unless it is a deletion.
    """
    w = W.partitionBy("key").orderBy(*order)
    state = F.struct(F.coalesce("is_delete", F.lit(False)).alias("gone"), "value")
    before = F.lag(state).over(w)
    gone = F.coalesce(F.col("is_delete"), F.lit(False))
    rows = versions.withColumn("__before", before).withColumn("__gone", gone)
    first = F.col("__before").isNull() & ~F.col("__gone")
    changed = F.col("__before").isNotNull() & ((F.col("__before.gone") != F.col("__gone")) | (~F.col("__gone") & ~F.col("__before.value").eqNullSafe(F.col("value"))))
    return rows.where(first | changed).withColumn("previous", F.when(~F.col("__before.gone"), F.col("__before.value"))).drop("__before", "__gone")


def latest(versions: DataFrame, key: str, version: Column, value: Column) -> DataFrame:
    """The value of the largest version of each key."""
    return versions.groupBy(key).agg(F.max_by(value, version).alias("value"))
