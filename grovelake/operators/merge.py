"""Three-way merge: one kernel for keys with values of any type, bytes, rows and vectors alike.

Policy ``store``: a deletion on either side wins over a change on the other; ``strict``: that is a conflict.
Resolvers are expressions over (key, base, source, dest, in_base, in_source, in_dest) that give a struct
(resolved, present, value); what they leave unresolved stays a conflict.
"""

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Resolver = Callable[[], Column]


def _outcome(resolved: Column, present: Column, value: Column) -> Column:
    return F.struct(resolved.alias("resolved"), present.alias("present"), value.alias("value"))


def take_source() -> Column:
    return _outcome(F.lit(True), F.col("in_source"), F.col("source"))


def take_destination() -> Column:
    return _outcome(F.lit(True), F.col("in_dest"), F.col("dest"))


ignore_conflicts = take_destination


def agent_priority() -> Column:
    """The source where it is there, else the destination."""
    return _outcome(F.lit(True), F.col("in_source") | F.col("in_dest"), F.when(F.col("in_source"), F.col("source")).otherwise(F.col("dest")))


def timestamp(of: Callable[[Column, Column], Column] | None = None) -> Resolver:
    """The side of the later time, the source on a tie or without times; by default the time in ``timestamp:<n>`` of the key."""
    of = of or (lambda key, value: F.try_to_number(F.regexp_extract(key.cast("string"), r"timestamp:(\d+)", 1), F.lit("99999999999999999999")))

    def resolve() -> Column:
        s = F.when(F.col("in_source"), of(F.col("key"), F.col("source")))
        d = F.when(F.col("in_dest"), of(F.col("key"), F.col("dest")))
        keep_dest = F.coalesce(d > s, s.isNull() & d.isNotNull()) | ~F.col("in_source")
        return _outcome(F.lit(True), F.col("in_source") | F.col("in_dest"), F.when(keep_dest, F.col("dest")).otherwise(F.col("source")))

    return resolve


def merged_json(source, dest):
    """Objects are united (the source wins at scalars), arrays are dest and what only the source has."""
    if isinstance(source, dict) and isinstance(dest, dict):
        return dest | {k: merged_json(v, dest[k]) if k in dest else v for k, v in source.items()}
    if isinstance(source, list) and isinstance(dest, list):
        known = {json.dumps(x, sort_keys=True) for x in dest}  # 1, 1.0 and true differ
        return dest + [x for x in source if json.dumps(x, sort_keys=True) not in known]
    return source


def _merge_texts(source: pa.Array, dest: pa.Array) -> pa.Array:
    out = []
    for s, d in zip(source.to_pylist(), dest.to_pylist()):
        try:
            out.append(s if s is None or d is None else json.dumps(merged_json(json.loads(s), json.loads(d)), separators=(",", ":"), ensure_ascii=False))
        except (ValueError, RecursionError):  # no JSON, or too deep to be read
            out.append(s)
    return pa.array(out, pa.string())


def semantic() -> Column:
    """Deep merge of JSON texts; the source where one is no JSON or only one side is there."""
    @F.arrow_udf("string")
    def joined(source: pa.Array, dest: pa.Array) -> pa.Array:
        return _merge_texts(source, dest)

    both = F.col("in_source") & F.col("in_dest")
    value = F.when(both, joined(F.col("source").cast("string"), F.col("dest").cast("string"))).when(F.col("in_source"), F.col("source").cast("string")).otherwise(F.col("dest").cast("string"))
    return _outcome(F.lit(True), F.col("in_source") | F.col("in_dest"), value)


def mean_vector(metric: str = "cosine") -> Resolver:
    """The mean of both vectors; of different lengths: unresolved. Inner product has no mean: refused."""
    if metric == "inner_product":
        raise ValueError("the mean of vectors has no meaning under inner product")

    def resolve() -> Column:
        same = F.col("in_source") & F.col("in_dest") & (F.size("source") == F.size("dest"))
        mean = F.zip_with("source", "dest", lambda a, b: ((a + b) * F.lit(0.5).cast("float")).cast("float"))
        return _outcome(F.coalesce(same, F.lit(False)), F.lit(True), F.when(same, mean))

    return resolve


latest_vector = timestamp


def merge3(base: DataFrame, source: DataFrame, dest: DataFrame, policy: str = "store", resolver: Resolver | None = None) -> DataFrame:
    """What to do to ``dest``: (key, op, value, base, source, dest), op added, modified, removed or conflict.

    One chain of two full outer joins on the key: both exchange by key, the second reuses the first's partitioning.
    """
    if policy not in ("store", "strict"):
        raise ValueError("policy is 'store' or 'strict'")
    side = lambda df, name: df.select("key", F.col("value").alias(name), F.lit(True).alias(f"in_{name}"))
    all3 = side(base, "base").join(side(source, "source"), "key", "full_outer").join(side(dest, "dest"), "key", "full_outer")
    all3 = all3.withColumns({f"in_{x}": F.coalesce(f"in_{x}", F.lit(False)) for x in ("base", "source", "dest")})
    b, s, d = F.col("in_base"), F.col("in_source"), F.col("in_dest")
    eq = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    strict = F.lit(policy == "strict")
    op = (
        F.when(s & d & eq("source", "dest"), F.lit(None))
        .when(b & s & d, F.when(eq("base", "dest"), "modified").when(eq("base", "source"), F.lit(None)).otherwise("conflict"))
        .when(~b & s & ~d, "added")
        .when(~b & s & d, "conflict")
        .when(b & ~s & d, F.when(eq("base", "dest") | ~strict, "removed").otherwise("conflict"))
        .when(b & s & ~d, F.when(strict & ~eq("base", "source"), "conflict"))
    )
    found = all3.withColumn("op", op).where("op IS NOT NULL")
    if resolver is None:
        value = F.when(F.col("op").isin("added", "modified"), F.col("source"))
        return found.select("key", "op", value.alias("value"), "base", "source", "dest")
    done = F.col("__r.resolved") & (F.col("op") == "conflict")
    after = F.when(~F.col("__r.present"), "removed").when(d, "modified").otherwise("added")
    out = found.withColumn("__r", resolver()).withColumn("__op", F.when(done, after).otherwise(F.col("op")))
    value = F.when(done, F.when(F.col("__r.present"), F.col("__r.value"))).when(F.col("op").isin("added", "modified"), F.col("source"))
    unchanged = done & ((F.col("__r.present") & d & F.col("__r.value").eqNullSafe(F.col("dest"))) | (~F.col("__r.present") & ~d))
    return out.where(~unchanged).select("key", F.col("__op").alias("op"), value.alias("value"), "base", "source", "dest")


def conflicts(merge: DataFrame) -> DataFrame:
    return merge.where("op = 'conflict'").select("key", "base", "source", "dest")


def apply_merge(dest: DataFrame, merge: DataFrame) -> DataFrame:
    """``dest`` after a merge; conflicts leave their keys as they were."""
    done = merge.where("op <> 'conflict'")
    kept = dest.select("key", "value").join(done.select("key"), "key", "left_anti")
    return kept.unionByName(done.where("op <> 'removed'").select("key", "value"))
