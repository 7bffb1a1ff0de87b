"""Exact nearest neighbours of many queries: blocks of vectors compared by matrix products, what comes near by the distance itself.

Vectors are packed into blocks; each task takes blocks of queries and a slab of blocks of vectors. A product in single
precision, less a bound of its error, only tells which pairs can't be among the k nearest; all others get the distance
in double precision, summed in the order of ``functions.distance``. Vectors with elements that are null, not finite or
very large or small always get it.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import written

BLOCK, AT_ONCE = 8192, 2048  #: vectors of a block; of a product
SLAB_BYTES = 64_000_000  #: vectors that a task holds, about
LEAST_TASKS = 36
EPS = 2.0**-24


def _kind(id_type: T.DataType) -> T.StructType:
    f = T.StructField
    return T.StructType([f("block", T.LongType()), f("dim", T.IntegerType()), f("ids", T.ArrayType(id_type)), f("keys", T.BinaryType()), f("data", T.BinaryType()), f("nulls", T.BinaryType())])


def _kept(data: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Rows but those of a vector that k rows of smaller keys have too: no query has them among its k nearest."""
    raw = np.ascontiguousarray(data)
    inverse = np.unique(raw.view(np.dtype((np.void, raw.itemsize * raw.shape[1]))).ravel(), return_inverse=True)[1].ravel()
    order = np.lexsort((np.arange(len(keys)), keys, inverse))
    group, key = inverse[order], keys[order]
    first = np.r_[True, (group[1:] != group[:-1]) | (key[1:] != key[:-1])]
    order, group = order[first], group[first]
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    rank = np.arange(len(group)) - np.repeat(starts, np.diff(np.r_[starts, len(group)]))
    return np.sort(order[rank < k])


def _pack(dtype: str, id_type: T.DataType, k: int | None):
    """Arrow batches of (id, vector) as blocks; with k, of vectors that are sorted by id and may be among the k nearest."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(_kind(id_type))

    def made(dim: int, parts: list, number: int) -> pa.RecordBatch:
        ids = pa.concat_arrays([p[0] for p in parts])
        keys, data, nulls = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
        if k is not None and dim:
            keep = _kept(data, keys, k)
            ids, keys, data, nulls = ids.take(pa.array(keep)), keys[keep], data[keep], nulls[keep]
        lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        columns = [pa.array([number]), pa.array([dim], pa.int32()), lists, *(pa.array([x.tobytes()], pa.binary()) for x in (keys, data, nulls))]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, key, last = TaskContext.get().partitionId() << 32, -1, None
        held: dict[int, list] = {}
        for batch in batches:
            there = batch["vector"].is_valid()
            ids, lists = batch["id"].filter(there), batch["vector"].filter(there)
            if not len(ids):
                continue
            if k is None:
                keys = np.zeros(len(ids), np.int64)
            else:  # rows of one id follow each other
                coded = ids.dictionary_encode() if not pa.types.is_nested(ids.type) else pa.array([repr(x) for x in ids.to_pylist()]).dictionary_encode()
                code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                again = last is not None and last == ids[0]
                keys = key + (not again) + np.cumsum(np.r_[0, code[1:] != code[:-1]])
                key, last = int(keys[-1]), ids[len(ids) - 1]
            size = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            null = flat.is_null().to_numpy(zero_copy_only=False)
            values = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(dtype, copy=False)
            starts = np.r_[0, np.cumsum(size)]
            for dim in np.unique(size):
                at = np.flatnonzero(size == dim)
                index = starts[at][:, None] + np.arange(dim)
                mine = held.setdefault(int(dim), [])
                for lo in range(0, len(at), BLOCK):
                    some = slice(lo, lo + BLOCK)
                    mine.append((ids.take(pa.array(at[some])), keys[at[some]], values[index[some]], null[index[some]].any(1)))
                    if sum(len(p[1]) for p in mine) >= BLOCK:
                        yield made(int(dim), mine, number)
                        number += 1
                        mine.clear()
        for dim, mine in held.items():
            if mine:
                yield made(dim, mine, number)
                number += 1

    return run


def packed(rows: DataFrame, k: int | None = None) -> DataFrame:
    """Blocks of (id, vector), written. With k, of the vectors that are searched: each partition is sorted by id."""
    kind = rows.schema["vector"].dataType.elementType
    rows = rows.select("id", F.col("vector").cast("array<float>" if isinstance(kind, T.FloatType) else "array<double>").alias("vector"))
    rows = rows if k is None else rows.sortWithinPartitions("id")
    dtype = "<f4" if isinstance(kind, T.FloatType) else "<f8"
    id_type = rows.schema["id"].dataType
    return written(rows.mapInArrow(_pack(dtype, id_type, k), _kind(id_type)), "blocks")


class _Side:
    """A block: doubles by element, norms, those in single precision that products are of, and which rows they don't serve."""

    def __init__(self, dim: int, data: bytes, nulls: bytes, dtype: str, metric: str, query: bool) -> None:
        self.null = np.frombuffer(nulls, bool).copy()  # what is kept must not hold the batch
        x = np.frombuffer(data, dtype).reshape(len(self.null), dim).astype(float)
        self.x = np.ascontiguousarray(x.T)
        with np.errstate(all="ignore"):
            self.square = np.add.reduce(self.x * self.x, axis=0) if dim else np.zeros(len(x))
            norm = np.sqrt(self.square)
            zero = ~x.any(1)
            self.odd = self.null | ~(zero | ((norm > 1e-12) & (norm < 1e12)))
            plain = np.where(self.odd[:, None], 0.0, x)
            self.norm = np.where(self.odd, 0.0, norm)
            if metric == "cosine":
                plain /= np.where(self.norm > 0, self.norm, 1)[:, None]
            elif metric == "l2":
                plain = np.c_[plain, np.ones(len(x)) if query else -0.5 * self.norm**2]
        single = plain.astype(np.float32)
        self.single = single if query else np.ascontiguousarray(single.T)
        self.n, self.most = len(x), float(self.norm.max(initial=0))


def _exact(metric: str, q: _Side, v: _Side, qi: np.ndarray, vi: np.ndarray) -> np.ndarray:
    """The distances of pairs as ``functions.distance`` has them; sums run over the elements in turn. Elements that are null must be left out."""
    out = np.empty(len(qi))
    with np.errstate(all="ignore"):
        for lo in range(0, len(qi), BLOCK):
            a, b = qi[lo : lo + BLOCK], vi[lo : lo + BLOCK]
            x, y = np.take(q.x, a, axis=1), np.take(v.x, b, axis=1)
            x = np.square(np.subtract(x, y, out=x), out=x) if metric == "l2" else np.multiply(x, y, out=x)
            total = np.add.reduce(x, axis=0) if len(x) else np.zeros(len(a))
            if metric == "l2":
                d = np.sqrt(total)
            elif metric == "inner_product":
                d = -total
            else:
                norm = q.square[a] * v.square[b]
                cos = total / np.sqrt(norm)
                d = np.where(norm == 0, 1.0, 1 - np.clip(cos, -1, 1))
            out[lo : lo + BLOCK] = d
    return out


class _Best:
    """The k nearest so far of each query of a block: pairs sorted by query, distance and key."""

    def __init__(self, q: _Side, k: int, metric: str) -> None:
        self.q, self.k, self.metric, self.seen, self.told = q, k, metric, 0, 0
        self.held = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.new: list[tuple] = []
        self.pending = 0
        self.kth, self.kth_key = np.full(q.n, np.inf), np.zeros(q.n, np.int64)
        self.full = np.zeros(q.n, bool)
        self.last_key, self.ordered, self.repeated = -1, True, False  # of the keys so far

    def settle(self) -> None:
        """What is pending goes among the nearest; a key counts once, with its nearest."""
        qi, d, key, at = (np.concatenate(x) for x in zip(self.held, *self.new))
        if self.repeated:
            order = np.lexsort((at, d, key, qi))
            order = order[np.r_[True, (qi[order][1:] != qi[order][:-1]) | (key[order][1:] != key[order][:-1])][: len(order)]]
            order = order[np.lexsort((key[order], d[order], qi[order]))]
        elif self.ordered and self.q.n < 1 << 16:  # of one query and distance, keys already ascend
            order = np.argsort(d, kind="stable")
            order = order[np.argsort(qi[order].astype(np.uint16), kind="stable")]
        else:
            order = np.lexsort((key, d, qi))
        qi = qi[order]
        starts = np.flatnonzero(np.r_[True, qi[1:] != qi[:-1]][: len(qi)])
        rank = np.arange(len(qi)) - np.repeat(starts, np.diff(np.r_[starts, len(qi)]))
        order, qi = order[rank < self.k], qi[rank < self.k]
        self.held = (qi, d[order], key[order], at[order])
        last = rank[rank < self.k] == self.k - 1
        self.full[qi[last]] = True
        self.kth[qi[last]], self.kth_key[qi[last]] = self.held[1][last], self.held[2][last]
        self.new, self.pending, self.told = [], 0, self.seen

    def floors(self, v: _Side, first_key: int) -> np.ndarray:
        """The products that a pair has at least if it is among the nearest; their error is bounded generously."""
        q, c = self.q, 4 * EPS * (len(self.q.x) + 8)
        with np.errstate(all="ignore"):
            if self.metric == "cosine":
                floor = 1 - self.kth - c
                floor = np.where((q.norm == 0) & (self.kth == 1) & (self.kth_key < first_key), np.inf, floor)  # all are as far
            elif self.metric == "l2":
                half = (q.norm**2 - self.kth**2) / 2
                floor = half - c * (q.norm * v.most + v.most**2 + q.norm**2 + np.abs(half))
            else:
                floor = -self.kth - c * (q.norm * v.most + np.abs(self.kth))
        return np.where(self.full & ~q.odd & ~np.isnan(floor), floor, -np.inf).astype(np.float32)

    def add(self, v: _Side, keys: np.ndarray, offset: int) -> None:
        lo, odd, strangers = 0, np.flatnonzero(v.odd), self.q.null.any() or v.null.any()
        floor = self.floors(v, int(keys[0]))
        self.ordered &= bool(keys[0] > self.last_key)
        self.repeated |= bool((keys[1:] == keys[:-1]).any()) or int(keys[0]) == self.last_key
        self.repeated |= not self.ordered  # a key may be in two blocks
        self.last_key = int(keys[-1])
        while lo < v.n:
            hi = min(v.n, lo + min(AT_ONCE, max(64, self.seen)))
            strange = odd[(odd >= lo) & (odd < hi)] - lo
            for at in range(0, self.q.n, 1024):
                near = np.matmul(self.q.single[at : at + 1024], v.single[:, lo:hi]) >= floor[at : at + 1024, None]
                near[:, strange] = True
                if near.size % 8:
                    hit = np.flatnonzero(near)
                else:
                    some = np.flatnonzero(near.ravel().view(np.uint64))
                    where = np.flatnonzero(near.reshape(-1, 8)[some])
                    hit = some[where >> 3] * 8 + (where & 7)
                if len(hit):
                    qi, vi = at + hit // (hi - lo), lo + hit % (hi - lo)
                    if strangers:
                        there = ~(self.q.null[qi] | v.null[vi])
                        qi, vi = qi[there], vi[there]
                    d = _exact(self.metric, self.q, v, qi, vi)
                    self.new.append((qi, d, keys[vi], offset + vi))
                    self.pending += len(qi)
            self.seen += hi - lo
            lo = hi
            if self.pending and (self.seen >= 2 * self.told or self.pending > 64 * self.q.n):
                self.settle()
                floor = self.floors(v, int(keys[0]))


def _own(x: pa.Array) -> pa.Array:
    """A copy that does not hold the batch."""
    return x.take(pa.array(np.arange(len(x))))


def _searched(metric: str, k: int, types: tuple[str, str], schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def flushed(best: _Best | None, qids: pa.Array, ids: list) -> Iterator[pa.RecordBatch]:
        if best is None:
            return
        if best.pending:
            best.settle()
        qi, d, _, at = best.held
        if not len(qi):
            return
        found = pa.concat_arrays(ids).take(pa.array(at))
        yield pa.RecordBatch.from_arrays([qids.take(pa.array(qi)).cast(arrow.field(0).type), found.cast(arrow.field(1).type), pa.array(d)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, now, qids, ids, offset = None, None, None, [], 0
        for batch in batches:
            dims, qdims, numbers, qnumbers = (batch[c].to_pylist() for c in ("dim", "qdim", "block", "qblock"))
            for i in range(batch.num_rows):
                if dims[i] != qdims[i]:
                    continue
                here = (qnumbers[i], numbers[i] >> 32)
                if here != now:
                    yield from flushed(best, qids, ids)
                    q = _Side(qdims[i], batch["qdata"][i].as_buffer(), batch["qnulls"][i].as_buffer(), types[0], metric, True)
                    best, now, qids, ids, offset = _Best(q, k, metric), here, _own(batch["qids"][i].values), [], 0
                v = _Side(dims[i], batch["data"][i].as_buffer(), batch["nulls"][i].as_buffer(), types[1], metric, False)
                best.add(v, np.frombuffer(batch["keys"][i].as_buffer(), np.int64), offset)
                ids.append(_own(batch["ids"][i].values))
                offset += v.n
            del batch
        yield from flushed(best, qids, ids)

    return run


def nearest(queries: DataFrame, blocks: DataFrame, vector_type: T.DataType, k: int, metric: str, tasks: int) -> DataFrame:
    """(qid, id, distance): of each (qid, query) the k nearest ids of each slab of ``blocks``, and so the k nearest of all."""
    asked = packed(queries.select(F.col("qid").alias("id"), F.col("query").alias("vector")).repartition(tasks))
    left = asked.select(F.col("block").alias("qblock"), F.col("dim").alias("qdim"), F.col("ids").alias("qids"), F.col("data").alias("qdata"), F.col("nulls").alias("qnulls"))
    id_type = lambda df, c: df.schema[c].dataType.elementType
    schema = T.StructType([T.StructField("qid", id_type(left, "qids")), T.StructField("id", id_type(blocks, "ids")), T.StructField("distance", T.DoubleType())])
    dtype = lambda kind: "<f4" if isinstance(kind.elementType, T.FloatType) else "<f8"
    pairs = left.hint("shuffle_replicate_nl").crossJoin(blocks)
    return pairs.mapInArrow(_searched(metric, k, (dtype(queries.schema["query"].dataType), dtype(vector_type)), schema), schema)


def slabs_and_tasks(n: int, asked: int, dim: int) -> tuple[int, int]:
    """How many slabs n vectors make, and by how many tasks each is read for so many queries."""
    slabs = max(1, -(-n * (4 * dim + 24) // SLAB_BYTES))
    return slabs, max(1, min(-(-asked // 512), -(-LEAST_TASKS // slabs)))


def distances(metric: str):
    """The distance of ``functions.distance`` as a function of two columns, over Arrow batches of pairs."""

    def rows(x: pa.Array, at: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
        flat = x.take(pa.array(at)).flatten()
        null = flat.is_null().to_numpy(zero_copy_only=False).reshape(len(at), dim)
        return flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(float).reshape(len(at), dim), null.any(1)

    def summed(x: np.ndarray) -> np.ndarray:
        return np.add.reduce(np.ascontiguousarray(x.T), axis=0) if x.shape[1] else np.zeros(len(x))

    @F.arrow_udf("double")
    def distance(a: pa.Array, b: pa.Array) -> pa.Array:
        size, other = (x.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) for x in (a, b))
        out, there = np.zeros(len(size)), np.zeros(len(size), bool)
        with np.errstate(all="ignore"):
            for dim in np.unique(size[(size == other) & (size >= 0)]).tolist():
                at = np.flatnonzero((size == dim) & (other == dim))
                for lo in range(0, len(at), BLOCK):
                    some = at[lo : lo + BLOCK]
                    (x, xnull), (y, ynull) = (rows(z, some, dim) for z in (a, b))
                    if metric == "l2":
                        d = np.sqrt(summed((x - y) ** 2))
                    elif metric == "inner_product":
                        d = -summed(x * y)
                    else:
                        norm = summed(x * x) * summed(y * y)
                        d = np.where(norm == 0, 1.0, 1 - np.clip(summed(x * y) / np.sqrt(norm), -1, 1))
                    out[some], there[some] = d, ~(xnull | ynull)
        return pa.array(out, mask=~there)

    return distance
