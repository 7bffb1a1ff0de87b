"""Operator 5, SimHash near-dedup by bit sampling.

A text's 128-bit SimHash is the sign of the sum of +-1 over its word pairs' hashed bits (a text of one word
uses that word). Fingerprints that are equal are one node. Each table picks bits at random; nodes that agree in
them are a bucket. The number of bits follows from the number of nodes, so that a bucket holds about ``BUCKET``
unrelated ones, and the number of tables from the bits, so that a pair at ``MAX_DISTANCE`` meets in at least one
with probability ``RECALL`` at every size. Every pair within a bucket is verified: it counts when the distance of
all 128 bits is at most ``MAX_DISTANCE``. A bucket of more than ``MOST`` nodes is capped by more bits: it falls
into parts by bits of the nodes' mixed fingerprints, and each pair of its parts is compared as a unit of its own,
so no pair of the bucket is lost and no task holds more than two parts.

A unit hands on, for each node, one link of those that connect it and how many nodes it is near to that it met
in no earlier table; pairs aren't handed on. Links are joined to groups; the document of the smallest id stays.

Defined results: null and blank texts have no fingerprint, are never copies and all stay. Rows that repeat an
id and its text are copies of each other: one stays. Null ids sort last. Unused columns pass through, whatever
their names. ``n_links`` counts the other fingerprints near a row's own; rows of one fingerprint are one node.
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

MAX_DISTANCE, BUCKET, RECALL, SMALL = 26, 256, 0.95, 128
U64 = np.uint64
UNIT = ["t", "base", "i", "j"]


def plan(n: int, max_distance: int = MAX_DISTANCE, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a table, tables) for n nodes."""
    bits = min(31, max(0, math.ceil(math.log2(max(n, 1) / BUCKET))), 127 - max_distance)
    meet = math.prod((128 - max_distance - i) / (128 - i) for i in range(bits))
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet))) if meet < 1 else 1


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n, 2) unsigned halves, and whether a text has words."""
    out, some = np.zeros((len(texts), 2), U64), np.zeros(len(texts), bool)
    for row, data, offs in tb.slices(texts):
        starts, ends, first = tb.words(data, offs)
        h = tb.word_hashes(data, starts, ends)
        counts = np.diff(first)
        filled = np.flatnonzero(counts)
        if not len(filled):
            continue
        pair = h.copy()
        if len(h) > 1:
            pair[:-1] = tb.mix(h[:-1] * U64(31) + h[1:])
        # the last word of a text pairs with none: it counts alone where it is the only one, else not at all
        last = first[1:][filled] - 1
        alone = counts[filled] == 1
        pair[last[alone]] = h[last[alone]]
        weight = np.ones(len(h), bool)
        weight[last[~alone]] = False
        owner = np.repeat(np.arange(len(counts)), counts)[weight]
        pair = pair[weight]
        n = np.bincount(owner, minlength=len(counts))
        lo = (np.cumsum(n) - n)[filled]
        for half, key in enumerate((U64(0), U64(0xA5A5F00DBADC0DE1))):
            bits = np.unpackbits(tb.mix(pair ^ key).view(np.uint8).reshape(-1, 8), axis=1)
            ones = np.add.reduceat(bits, lo, axis=0, dtype=np.int32)
            packed = np.packbits(2 * ones > n[filled][:, None], axis=1)
            out[row + filled, half] = packed.view(U64)[:, 0]
        some[row + filled] = True
    return out, some


def sampled(tables: int, bits: int) -> np.ndarray:
    """The bits, out of 128, that each table picks."""
    return np.array([np.random.default_rng(7000 + t).permutation(128)[:bits] for t in range(tables)], np.int64).reshape(tables, bits)


def masks(picked: np.ndarray) -> np.ndarray:
    """Each table's bits as two integers."""
    each = np.zeros((len(picked), 128), np.uint8)
    each[np.arange(len(picked))[:, None], picked] = 1
    return np.packbits(each, axis=1).view(U64)


def bases(halves: np.ndarray, picked: np.ndarray) -> np.ndarray:
    """(tables, n): the sampled bits of each fingerprint as one integer."""
    each = np.unpackbits(np.ascontiguousarray(halves).view(np.uint8).reshape(-1, 16), axis=1)
    weight = 1 << np.arange(picked.shape[1])[::-1]
    return np.array([each[:, bits] @ weight for bits in picked], np.int64).reshape(len(picked), len(halves)).astype(np.int32)


def distance(h: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.bitwise_count(h[i, 0] ^ h[j, 0]).astype(np.int16) + np.bitwise_count(h[i, 1] ^ h[j, 1])


def first_met(h: np.ndarray, i: np.ndarray, j: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    """Whether pairs differ in the bits of every table of ``earlier``."""
    out = np.ones(len(i), bool)
    left, x = np.arange(len(i)), h[i] ^ h[j]
    for mask in earlier:
        met = ((x[:, 0] & mask[0]) | (x[:, 1] & mask[1])) == 0
        if met.any():
            out[left[met]] = False
            left, x = left[~met], x[~met]
            if not len(left):
                break
    return out


def unit_links(h: np.ndarray, table: np.ndarray, edge: np.ndarray, side: np.ndarray, mask: np.ndarray, max_distance: int = MAX_DISTANCE, small: int = SMALL) -> tuple[np.ndarray, np.ndarray]:
    """(label, count) of the rows of many units, which begin at ``edge``: labels are rows of the same unit."""
    n = len(h)
    label, count = np.arange(n), np.zeros(n, np.int64)
    size = np.diff(edge)
    whole = np.array([not side[a:b].any() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())], bool)
    end, at = np.repeat(edge[1:], size), np.flatnonzero(np.repeat((size <= small) & whole, size))
    for gap in range(1, small):  # small units at once
        at = at[at + gap < end[at]]
        if not len(at):
            break
        i = at[distance(h, at, at + gap) <= max_distance]
        j = i + gap
        for t in np.unique(table[i]).tolist():
            own = table[i] == t
            new = first_met(h, i[own], j[own], mask[:t])
            count += np.bincount(i[own][new], minlength=n) + np.bincount(j[own][new], minlength=n)
        while len(i):
            i, j = label[i], label[j]
            apart = i != j
            i, j = i[apart], j[apart]
            np.minimum.at(label, np.maximum(i, j), np.minimum(i, j))
            while (label != label[label]).any():
                label = label[label]
    for k in np.flatnonzero((size > small) | ~whole).tolist():
        a, b = int(edge[k]), int(edge[k + 1])
        own, earlier = h[a:b], mask[: table[a]]

        def close(x: slice, y: slice, own=own) -> np.ndarray:
            return np.bitwise_count(own[x, None, 0] ^ own[y, 0]) + np.bitwise_count(own[x, None, 1] ^ own[y, 1]) <= max_distance

        found, n_here = un.links(b - a, close, lambda i, j, own=own, earlier=earlier: first_met(own, i, j, earlier), side[a:b])
        label[a:b], count[a:b] = found + a, n_here
    return label, count


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, th, u, h1, h2) of the rows; th is a hash of the text, u differs in all rows, h1 and h2 are null where it has no words."""

    @F.arrow_udf("struct<h1: bigint, h2: bigint>")
    def fingerprint(texts: pa.Array) -> pa.Array:
        halves, some = fingerprints(texts)
        parts = [pa.array(halves[:, k].view(np.int64), pa.int64(), mask=~some) for k in (0, 1)]
        return pa.StructArray.from_arrays(parts, ["h1", "h2"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.monotonically_increasing_id().alias("u"), fingerprint(F.col(text)).alias("f"))
    return rows.select("id", "th", "u", "f.h1", "f.h2")


def near_links(nodes: DataFrame, tables: int | None = None, max_distance: int = MAX_DISTANCE, most: int = un.MOST) -> DataFrame:
    """(node, low, n) of ``nodes`` (node, h1, h2), whose fingerprints differ: in one unit, a node that links connect it with and how many near it are met first there."""
    bits, planned = plan(nodes.count(), max_distance)
    picked = sampled(tables or planned, bits)
    mask = masks(picked)
    halves_of = lambda batch: np.stack([np.asarray(batch.column(k)).view(U64) for k in (1, 2)], 1)

    def sizes(batches):
        for batch in batches:
            for t, base in enumerate(bases(halves_of(batch), picked)):
                found, n = np.unique(base, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), t, np.int16)), pa.array(found), pa.array(n)], names=["t", "base", "n"])

    def spread(batches):
        for batch in batches:
            for t, base in enumerate(bases(halves_of(batch), picked)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(base), t, np.int16)), pa.array(base), batch.column(1), batch.column(2), batch.column(0)], names=["t", "base", "h1", "h2", "node"])

    def verify(batches):
        for rows in un.whole_units(batches, UNIT):
            h = np.stack([np.asarray(rows[x]).view(U64) for x in ("h1", "h2")], 1)
            label, count = unit_links(h, np.asarray(rows["t"]), un.edges_of(rows, UNIT), np.asarray(rows["side"]), mask, max_distance)
            some = np.flatnonzero((label != np.arange(len(h))) | (count > 0))
            node = np.asarray(rows["node"])
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[label[some]]), pa.array(count[some])], names=["node", "low", "n"])

    narrow = nodes.select("node", "h1", "h2")
    counts = narrow.mapInArrow(sizes, "t smallint, base int, n bigint").groupBy("t", "base").agg(F.sum("n").alias("n"))
    large = written(counts.where(F.col("n") > most), "large")  # mostly few: Spark broadcasts it where its size is small
    rows = narrow.mapInArrow(spread, "t smallint, base int, h1 bigint, h2 bigint, node bigint")
    placed = un.spread_units(rows, large, ["t", "base"], F.xxhash64("h2", "h1"), most).repartition(*UNIT).sortWithinPartitions(*UNIT, "side")
    return placed.mapInArrow(verify, "node bigint, low bigint, n bigint")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", tables: int | None = None, max_distance: int = MAX_DISTANCE, most: int = un.MOST) -> DataFrame:
    """(id, th, group_id, keep, n_links, blank) of each row of ``docs``; group_id is the smallest id of the group."""
    marks = written(fingerprint_table(docs, id_col, text), "fingerprints")
    node = F.xxhash64("h1", "h2")
    known = marks.where("h1 IS NOT NULL").select("id", "th", "u", node.alias("node"), "h1", "h2")
    nodes = written(known.select("node", "h1", "h2").distinct(), "nodes")
    found = written(near_links(nodes, tables, max_distance, most), "links")
    roots = components(found.where("node <> low").select("node", "low"), "node", "low")
    degree = found.groupBy("node").agg(F.sum("n").alias("n_links")).where("n_links > 0")
    grouped = known.select("id", "th", "u", "node").join(roots, "node", "left").join(degree, "node", "left").withColumn("root", F.coalesce("root", "node"))
    grouped = written(grouped, "grouped")
    least = grouped.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th", "u")).alias("least"))
    copies = grouped.join(least, "root").select("id", "th", F.col("least.id").alias("group_id"), (F.col("u") == F.col("least.u")).alias("keep"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.lit(False).alias("blank"))
    return copies.unionByName(marks.where("h1 IS NULL").select("id", "th", F.col("id").alias("group_id"), F.lit(True).alias("keep"), F.lit(0).cast("bigint").alias("n_links"), F.lit(True).alias("blank")))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group; columns as they were."""
    per = near_groups(docs, id_col, text).groupBy(F.col("id").alias("__id"), F.col("th").alias("__th")).agg(F.max("keep").alias("keep"), ((F.count("*") == 1) | F.max("blank")).alias("all"))
    kept = written(per.where("keep").drop("keep"), "kept")
    rows = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), F.col(id_col).alias("__row_id"), F.xxhash64(text).alias("__row_th"))
    of = lambda which: rows.join(kept.where(which), rows["__row_id"].eqNullSafe(kept["__id"]) & (rows["__row_th"] == kept["__th"]), "left_semi")
    again = of("NOT all").groupBy("__row_id", "__row_th").agg(F.any_value("row").alias("row"))  # rows that repeat an id and its text
    return of("all").select("row").unionByName(again.select("row")).select("row.*")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_groups(docs).select(F.col("id").alias("doc_id"), "group_id", "keep", "n_links")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)
