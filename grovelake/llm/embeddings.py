"""Operator 6, embedding near-dedup by Euclidean p-stable hashing.

Vectors are normalised; equal ones are one node. A table's key is the tuple of floor((a . x + b) / ``WIDTH``)
over k random Gaussian projections. With p(d) the chance that one projection puts two vectors of distance d in
one cell, k is chosen so that n * p(d of unrelated vectors) ** k is about 1, and the number of tables so that a
pair at the threshold meets in at least one with probability ``RECALL``: among unrelated vectors the work grows as
n ** (1 + rho), not as its square. Vectors that are near each other share buckets, however many they are: each
pair within a bucket is checked by its exact cosine, block by block, and a bucket of more than ``MOST`` nodes is
compared in units of two of its parts (``units``), so memory is bounded and no pair is left out.

A unit hands on, for each node, one link of those that connect it and how many nodes it is near to that it met
in no earlier table (by its keys of all tables, kept with the vector). Connected components join the links; the
smallest id of a group stays.

Defined results: null and empty vectors, zero vectors and those with a null, NaN or infinite element match
nothing and stay. Vectors of different lengths never match. Rows that repeat an id and vector are copies: one
stays. Null ids sort last. A result has a row for each input row; ``n_links`` counts the other vectors near a
row's own, equal ones being one.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf as tb
from . import units as un
from .components import components
from .store import written

THRESHOLD, WIDTH, RECALL, SEED = 0.95, 2.0, 0.97, 40
U64 = np.uint64
UNIT = ["bucket", "i", "j"]


def meets(distance: float, width: float = WIDTH) -> float:
    """The chance that one projection puts vectors of this distance into one cell."""
    if distance <= 0:
        return 1.0
    r = width / distance
    return 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, threshold: float = THRESHOLD, width: float = WIDTH, recall: float = RECALL) -> tuple[int, int]:
    """(projections of a table, tables) for n nodes."""
    near, far = meets(math.sqrt(max(0.0, 2 - 2 * threshold)), width), meets(math.sqrt(2), width)
    k = max(4, math.ceil(math.log(max(n, 2)) / -math.log(far)))
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**k))) if near < 1 else 1


def unit(vectors: pa.Array) -> list[bytes | None]:
    """Each vector normalised, as little-endian 32-bit floats; None where it has no direction."""
    out: list = []
    for x in vectors.to_pylist():
        a = None if not x or any(e is None for e in x) else np.asarray(x, np.float64)
        top = 0.0 if a is None else float(np.abs(a).max())
        if not 0 < top < np.inf:
            out.append(None)
            continue
        a = a / top  # no square overflows or vanishes
        out.append((a / np.sqrt(a @ a)).astype("<f4").tobytes())
    return out


def _unit_rows(vectors: pa.Array) -> pa.Array:
    """``unit`` at once where all vectors are of one length and finite."""
    n = len(vectors)
    flat, offs = vectors.flatten(), np.diff(np.asarray(vectors.offsets))
    if n and not vectors.null_count and not flat.null_count and offs.min() == offs.max() > 0:
        a = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
        norm = np.sqrt((a * a).sum(1))
        if np.isfinite(norm).all() and norm.min() > 1e-100:
            rows = (a / norm[:, None]).astype("<f4")
            edge = (np.arange(n + 1) * 4 * rows.shape[1]).astype(np.int32)
            return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(edge.tobytes()), pa.py_buffer(rows.tobytes())])
    return pa.array(unit(vectors), pa.binary())


def keys(rows: np.ndarray, k: int, tables: int, width: float, seed: int) -> np.ndarray:
    """(vectors, tables) hashed bucket keys."""
    rng = np.random.default_rng([seed, rows.shape[1]])
    out = np.empty((len(rows), tables), U64)
    for t in range(tables):
        cells = np.floor((rows @ rng.normal(size=(rows.shape[1], k)).astype(np.float32) + rng.uniform(0, width, k).astype(np.float32)) / width).astype(np.int64)
        h = np.full(len(rows), rows.shape[1], U64)
        for j in range(k):
            h = tb.mix(h * U64(31) + cells[:, j].view(U64))
        out[:, t] = h
    return out


def links(rows: np.ndarray, threshold: float, block: int = 1024) -> np.ndarray:
    """For each row, the smallest row that pairs of cosine >= threshold connect it with."""
    return un.links(len(rows), lambda a, b: rows[a] @ rows[b].T >= threshold, lambda i, j: np.ones(len(i), bool), None, block)[0]


def unit_links(rows: np.ndarray, met: np.ndarray, table: int, side: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(label, count) of one unit of a table's bucket; ``met`` holds each row's keys of all tables."""

    def first(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.ones(len(i), bool)
        for a in range(0, len(i), 65536):
            at = slice(a, a + 65536)
            out[at] = ~(met[i[at], :table] == met[j[at], :table]).any(1)
        return out

    return un.links(len(rows), lambda a, b: rows[a] @ rows[b].T >= threshold, first, side)


def near_links(nodes: DataFrame, k: int, tables: int, threshold: float = THRESHOLD, width: float = WIDTH, seed: int = SEED, most: int = un.MOST) -> DataFrame:
    """(node, low, n) of ``nodes`` (node, v): in one unit, a node that links connect it with and how many near it are met first there."""

    @F.arrow_udf("binary")
    def keyed(vectors: pa.Array) -> pa.Array:
        each = vectors.to_pylist()
        size, out = np.array(list(map(len, each))), np.empty((len(each), tables), U64)
        for length in np.unique(size):
            at = np.flatnonzero(size == length)
            out[at] = keys(np.frombuffer(b"".join(each[i] for i in at), "<f4").reshape(len(at), -1), k, tables, width, seed)
        return pa.array([x.tobytes() for x in out], pa.binary())

    def buckets(batch) -> np.ndarray:
        met = np.frombuffer(b"".join(batch.column(1).to_pylist()), U64).reshape(-1, tables)
        return tb.mix(met + np.arange(tables, dtype=U64)).view(np.int64)

    def sizes(batches):
        for batch in batches:
            if batch.num_rows:
                found, n = np.unique(buckets(batch), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["bucket", "n"])

    def spread(batches):
        for batch in batches:
            if batch.num_rows:
                found = buckets(batch)
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(found[:, t].copy()), pa.array(np.full(len(found), t, np.int32)), batch.column(0)], names=["bucket", "t", "node"])

    def verify(batches):
        for rows in un.whole_units(batches, UNIT, 8192):
            edge = un.edges_of(rows, UNIT)
            node, side, table = np.asarray(rows["node"]), np.asarray(rows["side"]), np.asarray(rows["t"])
            vectors, met = rows["v"].to_pylist(), np.frombuffer(b"".join(rows["met"].to_pylist()), U64).reshape(-1, tables)
            lengths = np.array(list(map(len, vectors)))
            out: list[list] = [[], [], []]
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
                for length in np.unique(lengths[lo:hi]):
                    at = lo + np.flatnonzero(lengths[lo:hi] == length)
                    label, count = unit_links(np.frombuffer(b"".join(vectors[i] for i in at), "<f4").reshape(len(at), -1), met[at], int(table[lo]), side[at], threshold)
                    some = np.flatnonzero((label != np.arange(len(at))) | (count > 0))
                    for column, x in zip(out, (node[at[some]], node[at[label[some]]], count[some])):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["node", "low", "n"])

    held = written(nodes.select("node", "v", keyed("v").alias("met")), "keyed")
    shared = held.select("node", "met")
    counts = written(shared.mapInArrow(sizes, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).where("n > 1"), "buckets")
    rows = shared.mapInArrow(spread, "bucket bigint, t int, node bigint").join(counts.select("bucket"), "bucket", "left_semi")
    units = un.spread_units(rows, counts, ["bucket"], F.xxhash64("node"), most)
    placed = units.join(held, "node").repartition(*UNIT).sortWithinPartitions(*UNIT, "side")
    return placed.mapInArrow(verify, "node bigint, low bigint, n bigint")


def near_groups(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, width: float = WIDTH, recall: float = RECALL, most: int = un.MOST) -> DataFrame:
    """(id, group_id, keep, n_links) of each row; group_id is the smallest id of the group."""

    @F.arrow_udf("binary")
    def normal(vectors: pa.Array) -> pa.Array:
        return _unit_rows(vectors)

    marks = rows.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("u"), normal(F.col(vector).cast("array<double>")).alias("v"))
    marks = written(marks.withColumn("node", F.xxhash64("v")), "unit")
    nodes = written(marks.where("v IS NOT NULL").groupBy("node").agg(F.min("v").alias("v")), "nodes")
    k, tables = plan(nodes.count(), threshold, width, recall)
    found = written(near_links(nodes, k, tables, threshold, width, most=most), "links")
    roots = components(found.where("node <> low").select("node", "low"), "node", "low")
    degree = found.groupBy("node").agg(F.sum("n").alias("n_links"))
    known = marks.where("v IS NOT NULL").select("id", "u", "node").join(roots, "node", "left").join(degree, "node", "left")
    known = written(known.select("id", "u", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "grouped")
    least = known.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "u")).alias("least"))
    grouped = known.join(least, "root").select("id", F.col("least.id").alias("group_id"), (F.col("u") == F.col("least.u")).alias("keep"), "n_links")
    return grouped.unionByName(marks.where("v IS NULL").select("id", F.col("id").alias("group_id"), F.lit(True).alias("keep"), F.lit(0).cast("bigint").alias("n_links")))


def op6_embeddings(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return near_groups(rows).select(F.col("id").alias("vec_id"), "group_id", "keep", "n_links")
