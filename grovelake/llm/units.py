"""Buckets of a hash table compared in units of bounded size.

A bucket of at most ``most`` members is one unit. A larger one is cut into parts by more bits of its members' own
hashes, and each pair of its parts is a unit of its own: every pair of members is compared in exactly one unit,
while no task holds more than two parts at a time and a bucket's work spreads over many tasks.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 4096
U64 = np.uint64


def spread_units(rows: DataFrame, counts: DataFrame, bucket: list[str], member: Column, most: int = MOST) -> DataFrame:
    """``rows`` with (i, j, side): the unit of each member, and in which of its two parts it is.

    ``counts`` has (bucket, n) of the buckets of more than one member; it is written, so that its size is known.
    """
    large = counts.where(F.col("n") > most)
    parts = F.ceil(F.col("n") / (most // 2)).cast("int")
    sized = rows.join(large.select(*bucket, parts.alias("parts")), bucket, "left")
    own = F.pmod(member, F.col("parts")).cast("int")
    units = F.when(F.col("parts").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(F.least(own, q).alias("i"), F.greatest(own, q).alias("j"), (own > q).cast("int").alias("side")))
    )
    return sized.withColumn("unit", F.explode(units)).select(*rows.columns, "unit.*")


def whole_units(batches: Iterator[pa.RecordBatch], keys: list[str], rows_at_once: int = 50_000) -> Iterator[pa.Table]:
    """Sorted batches as tables that hold whole units: no unit is cut."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        n += batch.num_rows
        if n < rows_at_once:
            continue
        table = pa.concat_tables(held)
        ends = np.flatnonzero(_moved(table, keys))
        if len(ends):  # the last unit may go on in the next batch
            cut = int(ends[-1]) + 1
            yield table.slice(0, cut)
            table = table.slice(cut).combine_chunks()
        held, n = [table], table.num_rows if len(ends) else 0  # a unit is bounded: what is held is too
    if held:
        table = pa.concat_tables(held)
        if table.num_rows:
            yield table


def _moved(table: pa.Table, keys: list[str]) -> np.ndarray:
    out = np.zeros(max(0, table.num_rows - 1), bool)
    for name in keys:
        x = np.asarray(table[name])
        out |= x[1:] != x[:-1]
    return out


def edges_of(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where each unit begins, and the end."""
    return np.concatenate([[0], np.flatnonzero(_moved(table, keys)) + 1, [table.num_rows]])


def links(n: int, close: Callable[[slice, slice], np.ndarray], first: Callable[[np.ndarray, np.ndarray], np.ndarray], side: np.ndarray | None = None, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(label, count) of the n members of a unit: the smallest member that close pairs connect each with, and with how many it pairs first here.

    ``close`` tells of two ranges which pairs are close, ``first`` of pairs which were not met in an earlier table.
    With two ``side``s only pairs across are compared. Blocks keep memory bounded however many pairs are close.
    """
    label, count = np.arange(n), np.zeros(n, np.int64)
    if side is None or not side.any():
        ranges = [(a, b) for a in range(0, n, block) for b in range(a, n, block)]
        stops = dict.fromkeys(range(0, n, block), n)
    else:  # rows of side 0 come before those of side 1
        turn = int(np.searchsorted(side, 1))
        ranges = [(a, b) for a in range(0, turn, block) for b in range(turn, n, block)]
        stops = {a: turn for a in range(0, turn, block)} | {b: n for b in range(turn, n, block)}
    for a, b in ranges:
        i, j = np.nonzero(close(slice(a, min(a + block, stops[a])), slice(b, min(b + block, stops[b]))))
        i, j = i + a, j + b
        if a == b:
            i, j = i[i < j], j[i < j]
        if not len(i):
            continue
        new = first(i, j)
        count += np.bincount(i[new], minlength=n) + np.bincount(j[new], minlength=n)
        i, j = label[i], label[j]
        while len(i):
            i, j = label[i], label[j]
            apart = i != j
            i, j = i[apart], j[apart]
            np.minimum.at(label, np.maximum(i, j), np.minimum(i, j))
            while (label != label[label]).any():
                label = label[label]
    return label, count
