"""Connected components by alternating large-star and small-star steps on an edge table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop_written, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): each node of an edge with the smallest node that it is connected to.

    The number of rounds grows with the logarithm of the longest path. Each round is a table in the shared
    folder, so that lineage stays short and a lost executor costs no more than its own tasks. A node's smallest
    neighbour is aggregated before it is shuffled and joined back, so a node of very many edges is no task of its
    own. Null ends, loops and repeated edges are dropped; an edge table without rows gives none.
    """
    clean = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    now = written(clean.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _checksum(now)
    while mark[0]:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.distinct(), "edges")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select("v", "m").union(lowest.select("u", "m")).toDF("u", "v")
        after = written(small.where("u <> v").distinct(), "edges")
        found = _checksum(after)
        drop_written(now)
        drop_written(large)
        now = after
        if found == mark:
            break
        mark = found
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v"), F.col("v")).distinct())


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
