"""Operator 10, sharding by weighted rendezvous hashing.

Each shard j of weight w scores a key by -ln(u) / w, u in (0, 1) being the first 52 bits of
md5(key ':' j); the smallest score wins, so a shard's share follows its weight. A key moves only to a new
shard that wins it, or away from a shard that is gone: adding one of n equal shards moves 1 / (n + 1) of the
keys. The scores are one expression of the row: no shuffle, no join, no Python.

Defined results: a null key is the key ``<null>``; equal keys share a shard; the lower shard wins a tie; a
shard of weight 0 or less takes no key, and without any shard of positive weight the shard is null.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEIGHTS = [1.0] * 24 + [2.0] * 8
GROWN = [*WEIGHTS, 1.0]


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard (its place in ``weights``) of each key."""
    shards = [(j, float(w)) for j, w in enumerate(weights) if w > 0]
    if not shards:
        return F.lit(None).cast("int")
    text = F.coalesce(key.cast("string"), F.lit("<null>"))
    places = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(w).alias("w")) for j, w in shards])

    def score(s: Column) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat(text, F.lit(":"), s["j"].cast("string")).cast("binary")), 1, 13), 16, 10).cast("double")
        return F.struct((-F.log((bits + 0.5) / float(1 << 52)) / s["w"]).alias("score"), s["j"].alias("j"))

    return F.array_min(F.transform(places, score))["j"]


def assign_shards(df: DataFrame, key: str, weights: list[float], name: str = "shard") -> DataFrame:
    """``df`` with one more column, the shard of ``key``; a column of that name is replaced."""
    return df.withColumn(name, rendezvous(F.col(key), weights))


def write_shards(df: DataFrame, key: str, weights: list[float], path: str) -> None:
    """One folder ``shard=j`` for each shard; rows are first brought together by shard, in parts by a hash of the whole row.

    A column ``shard`` of the input is replaced. A key of very many rows spreads over its shard's parts.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // max(1, len(weights)))
    placed = assign_shards(df, key, weights, "shard")
    placed.repartition(F.col("shard"), F.pmod(F.xxhash64(*(F.col(c) for c in df.columns if c != "shard")), F.lit(parts))).write.mode("overwrite").partitionBy("shard").parquet(path)


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    out = docs.select("doc_id", rendezvous(F.col("doc_id"), WEIGHTS).alias("shard"), rendezvous(F.col("doc_id"), GROWN).alias("shard_grown"))
    return out.withColumn("moved", F.col("shard") != F.col("shard_grown"))


def _sql(weights: list[float]) -> str:
    values = ", ".join(f"({j}, {w}::DOUBLE)" for j, w in enumerate(weights))
    score = "-ln((('0x' || substr(md5(k || ':' || j), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / w"
    return f"SELECT k, arg_min(j, {score}) AS shard FROM (SELECT DISTINCT coalesce(doc_id::VARCHAR, '<null>') AS k FROM documents), (VALUES {values}) AS v(j, w) GROUP BY k"


ORACLE = f"""
WITH now AS ({_sql(WEIGHTS)}), grown AS ({_sql(GROWN)})
SELECT d.doc_id, now.shard::INTEGER AS shard, grown.shard::INTEGER AS shard_grown, now.shard <> grown.shard AS moved
FROM documents d JOIN now ON now.k = coalesce(d.doc_id::VARCHAR, '<null>') JOIN grown ON grown.k = now.k
"""
