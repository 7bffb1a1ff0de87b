"""Nearest neighbours: exact for batches of queries, approximate over a level tree built by joins."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.distance import METRICS
from ..tables import written
from .nearest import distances, nearest, packed, slabs_and_tasks

FEW = 100  #: queries that are joined to all vectors
BLOCKED = ("l2", "cosine", "inner_product")  #: metrics that ``nearest`` has
Metric = str | Callable[[Column, Column], Column]


def _metric(metric: Metric):
    return METRICS[metric] if isinstance(metric, str) else metric


def _of_pairs(metric: Metric):
    """As ``_metric``; those of the library over Arrow batches."""
    return distances(metric) if metric in BLOCKED else _metric(metric)


def checked(vectors: DataFrame, dim: int) -> DataFrame:
    """(id, vector); the query fails at a vector of another length. A dimension of 0 is refused."""
    if dim < 1:
        raise ValueError("a dimension must be positive")
    ok = F.coalesce(F.size("vector") == dim, F.lit(False))
    return vectors.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(f"a vector must have {dim} elements")).cast("boolean")))


def exact_knn(queries: DataFrame, vectors: DataFrame, k: int, metric: Metric = "cosine") -> DataFrame:
    """(qid, id, distance, rank) of the k nearest of each (qid, query); ties by id, NaN last. Each task keeps its k best.

    More than ``FEW`` queries under a metric of the library are compared by blocks.
    """
    asked = queries.limit(FEW + 1).count() if metric in BLOCKED and k > 0 else 0
    if asked <= FEW:
        pairs = vectors.select("id", "vector").crossJoin(queries.select("qid", "query"))
        scored = pairs.select("qid", "id", _metric(metric)(F.col("query"), F.col("vector")).alias("distance")).where("distance IS NOT NULL")
    else:
        n, dim = vectors.agg(F.count("*"), F.max(F.size("vector"))).first()
        slabs, tasks = slabs_and_tasks(n, queries.count(), dim or 0)
        blocks = packed(vectors.select("id", "vector").repartition(slabs, "id"), k).coalesce(slabs)
        scored = nearest(queries, blocks, vectors.schema["vector"].dataType, k, metric, tasks)
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("distance", "id"))).where(F.col("rank") <= k)


def level(id_: Column, vector: Column, level_bits: int = 4) -> Column:
    """Leading zero bits of the entry's SHA-256 over level_bits, 31 at most: a share 2^-level_bits of a level rises."""
    h = F.sha2(F.concat_ws("|", id_.cast("string"), vector.cast("array<string>")), 256)
    value = F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint")
    zeros = F.when(value == 0, 60).otherwise(60 - F.length(F.bin(value)))
    return F.least(F.floor(zeros / level_bits), F.lit(31)).cast("int")


def build_tree(vectors: DataFrame, metric: Metric = "cosine", level_bits: int = 4) -> tuple[DataFrame, DataFrame, int]:
    """(inner (level, bucket, child, id, vector), leaves (bucket, id, vector), top level): a function of the set only.

    At each level the entries that reach it are boundaries; every entry of a bucket goes to the nearest one
    (ties: the smaller id), by a join on the bucket. A bucket without boundary stays as it is.
    """
    dist = _of_pairs(metric)
    rows = written(vectors.select("id", "vector", level(F.col("id"), F.col("vector"), level_bits).alias("level"), F.lit("").alias("bucket")), "levels")
    top = rows.agg(F.max("level")).first()[0] or 0
    inner = None
    for at in range(top, 0, -1):
        bounds = rows.where(F.col("level") >= at).select("bucket", F.col("id").alias("bid"), F.col("vector").alias("bvec"))
        near = rows.join(bounds, "bucket", "left").groupBy("id").agg(F.min_by("bid", F.struct(F.coalesce(dist(F.col("vector"), F.col("bvec")), F.lit(float("inf"))), "bid")).alias("bid"))
        child = F.when(F.col("bid").isNull(), F.col("bucket")).otherwise(F.concat("bucket", F.lit("/"), F.col("bid").cast("string")))
        moved = written(rows.join(near, "id").select("id", "vector", "level", child.alias("bucket"), F.col("bucket").alias("up"), "bid"), "levels")
        nodes = moved.where((F.col("level") >= at) & (F.col("bid") == F.col("id"))).select(F.lit(at).alias("level"), F.col("up").alias("bucket"), F.col("bucket").alias("child"), "id", "vector")
        still = moved.where("bid IS NULL").select(F.lit(at).alias("level"), F.col("up").alias("bucket"), F.col("bucket").alias("child"), F.lit(None).cast(moved.schema["id"].dataType).alias("id"), F.lit(None).cast("array<float>").alias("vector")).distinct()
        inner = nodes.unionByName(still) if inner is None else inner.unionByName(nodes).unionByName(still)
        rows = moved.drop("up", "bid")
    leaves = rows.select("bucket", "id", "vector")
    if inner is None:
        inner = leaves.where("false").select(F.lit(0).alias("level"), "bucket", F.col("bucket").alias("child"), "id", "vector")
    return inner, leaves, top


def ann_knn(queries: DataFrame, tree: tuple[DataFrame, DataFrame, int], k: int, ef: int = 64, metric: Metric = "cosine") -> DataFrame:
    """As ``exact_knn``, over a beam of the ef nearest boundaries of each level; leaves are scored exactly."""
    inner, leaves, top = tree
    dist, ef = _of_pairs(metric), max(ef, k, 1)
    front = queries.select("qid", "query", F.lit("").alias("bucket"))
    for at in range(top, 0, -1):
        seen = front.join(inner.where(F.col("level") == at).drop("level"), "bucket")
        scored = seen.withColumn("d", F.coalesce(dist(F.col("query"), F.col("vector")), F.lit(-1.0)))
        best = W.partitionBy("qid").orderBy("d", "id")
        front = scored.withColumn("r", F.row_number().over(best)).where(F.col("r") <= ef).select("qid", "query", F.col("child").alias("bucket"))
    found = front.join(leaves, "bucket").select("qid", "id", dist(F.col("query"), F.col("vector")).alias("distance")).where("distance IS NOT NULL")
    return found.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("distance", "id"))).where(F.col("rank") <= k)
