"""Rows in one total order, cut by running counts: the cuts are the same however ids are spread or rows are stored.

A row's place is the sum of the counts of all rows before it. Rows are brought into ranges by their narrow keys
only; each range's sum goes to the driver (one number a range), which gives each range its offset. The wide rows
are then moved once, to the part that their place says, and read there in order, a batch at a time. The last key
makes every row different, so equal ids, null ids and repeated rows spread over the parts like all others.
"""

from bisect import bisect_right
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import written

PART, MOST_PARTS = 1 << 25, 100_000


def _order(keys: list[str]) -> list[Column]:
    return [F.col(k).asc_nulls_last() for k in keys]


def running(rows: DataFrame, keys: list[str], n: str = "n", carry: tuple = ()) -> tuple[DataFrame, int]:
    """(``keys``, ``carry``, ``n`` and ``before``, the sum of ``n`` over the rows before this one in the order of the keys; the sum of all)."""
    columns = [*keys, *carry]
    wanted = rows.select(*columns, F.col(n).cast("bigint").alias("n"))

    def sums(batches):
        pid, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            if batch.num_rows:
                size = np.asarray(batch.column(len(columns)))
                ends = total + np.cumsum(size)
                total = int(ends[-1])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends - size), pa.array(np.full(len(size), pid, np.int32))], names=[*columns, "n", "before", "pid"])

    kind = T.StructType([*wanted.schema.fields, T.StructField("before", T.LongType()), T.StructField("pid", T.IntegerType())])
    placed = written(wanted.repartitionByRange(*_order(keys)).sortWithinPartitions(*_order(keys)).mapInArrow(sums, kind), "running")
    of_range = sorted((r.pid, r.n) for r in placed.groupBy("pid").agg(F.sum("n").alias("n")).collect())  # one row for each range
    ends = np.cumsum([x for _, x in of_range]).tolist()
    offsets = rows.sparkSession.createDataFrame([(pid, int(end - x)) for (pid, x), end in zip(of_range, ends)], "pid int, __offset bigint")
    out = placed.join(F.broadcast(offsets), "pid").select(*columns, "n", (F.col("before") + F.col("__offset")).alias("before"))
    return out, int(ends[-1]) if ends else 0


def _comparable(value):
    if value is None:
        return (2, 0)
    return (1, 0) if value != value else (0, value)  # NaN after all numbers, null after all


def parted(rows: DataFrame, placed: DataFrame, total: int, keys: list[str], step: int = 1) -> tuple[DataFrame, list]:
    """(``rows`` with ``part``, those of a part one after another in the order of the keys; (start, keys of the first row) of each part).

    A part holds the rows whose place is in a range of about ``PART`` counts, whose ends are multiples of ``step``.
    """
    wanted = min(MOST_PARTS, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // PART))
    size = max(1, -(-total // (wanted * step))) * step
    firsts = placed.groupBy(F.expr(f"before div {size}").alias("k")).agg(F.min("before").alias("at"), F.min_by(F.struct(*keys), "before").alias("first"))
    starts = sorted(((r["at"], tuple(r["first"])) for r in firsts.collect()), key=lambda x: x[0])  # at most ``wanted`` rows
    bounds = [tuple(map(_comparable, first)) for _, first in starts[1:]]

    @F.arrow_udf("int")
    def part(found: pa.Array) -> pa.Array:
        columns = [[_comparable(x) for x in c.to_pylist()] for c in found.flatten()]
        return pa.array([bisect_right(bounds, key) for key in zip(*columns)], pa.int32())

    moved = rows.withColumn("part", part(F.struct(*keys))).repartitionById(max(1, len(starts)), F.col("part"))
    return moved.sortWithinPartitions("part", *_order(keys)), starts


def packed(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    """``flat`` cut into runs of ``counts`` elements, each compressed: what is shuffled and written is smaller."""
    squeeze, raw = zstandard.ZstdCompressor(level=1).compress, memoryview(np.ascontiguousarray(flat)).cast("B") if len(flat) else memoryview(b"")
    edge = (np.concatenate([[0], np.cumsum(counts)]) * flat.itemsize).tolist()
    return pa.array([squeeze(raw[a:b]) for a, b in zip(edge[:-1], edge[1:])], pa.binary())


def unpacked(values: list[bytes], kind: str) -> list[np.ndarray]:
    """What ``packed`` was given, a value at a time."""
    expand = zstandard.ZstdDecompressor().decompress
    return [np.frombuffer(expand(x), kind) for x in values]


def joined(parts: Iterable[pa.Array], names: list[str]) -> pa.Array:
    """Structs of a count and binaries, one after another; without parts an empty array of them."""
    found = list(parts)
    return pa.concat_arrays(found) if found else pa.array([], pa.struct([(x, pa.binary() if k else pa.int64()) for k, x in enumerate(names)]))
