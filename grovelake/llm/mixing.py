"""Operator 9, mixing sources to target weights.

Each source's documents are tokenised, closed by an end token and laid out in the order of their ids as one
stream, cut into blocks of ``BLOCK`` tokens (only a source's last one is shorter: nothing is dropped). The streams
are laid out by running token counts, so it makes no difference how ids are spread or how large a source is.
The mixture has as many slots as there are blocks, in shards of ``SHARD_SLOTS``; each shard draws its counts per
source from one multinomial with the target weights. The k-th slot of a source of n blocks takes block perm(k mod
n) of epoch k div n, perm being a keyed pseudorandom permutation of the indices (a Feistel network, walked along
cycles back into the range), so a source gives each block once before it gives any again. Slots are joined with
the blocks by (source, index).

Weights default to n ** ``ALPHA`` over the sources' tokens; sources without a weight in ``weights`` get none. A
mixture of more than ``MOST_SOURCES`` sources is refused: every shard draws over all of them.

Defined results: ids may be of any type that sorts. Null sources are one source; null and blank texts give no
tokens; an empty table gives no slot; rows of one id follow each other by a hash of the text, repeated rows are
each laid out, rows without an id are their source's last.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import runs
from . import textbuf as tb
from . import tokens as tk
from .store import drop_written, written

BLOCK, SHARD_SLOTS, ALPHA, SEED = 1024, 1024, 0.7, 17
MOST_SOURCES = 1_000_000
NONE = "\u0000none"
KEYS = ["source", "id", "th", "u"]
U64 = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def permuted_index(k: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """perm(k) for 0 <= k < n under ``key``: for each (n, key) a bijection of range(n)."""
    k, n, key = (np.asarray(x, np.int64).astype(U64) for x in (k, n, key))
    half = np.array([max(1, -(-max(int(m) - 1, 1).bit_length() // 2)) for m in n], U64)
    mask = (U64(1) << half) - U64(1)
    out, open_ = k.copy(), np.arange(len(k))
    while len(open_):
        x, h, m, s = out[open_], half[open_], mask[open_], key[open_]
        left, right = x >> h, x & m
        for r in range(4):
            left, right = right, left ^ (_mix(right + _mix(s + U64((r * 0x9E3779B97F4A7C15) % (1 << 64)))) & m)
        out[open_] = (left << h) | right
        open_ = open_[out[open_] >= n[open_]]
    return out.astype(np.int64)


def _perm(k, n, key):
    @F.arrow_udf("bigint")
    def index(k: pa.Array, n: pa.Array, key: pa.Array) -> pa.Array:
        return pa.array(permuted_index(k.to_numpy(zero_copy_only=False), n.to_numpy(zero_copy_only=False), key.to_numpy(zero_copy_only=False)))

    return index(k, n, key)


def sized_texts(texts: pa.Array, path: str) -> pa.Array:
    """(n, sizes, raw) of each text, compressed a slice at a time: a task never holds the tokens of a whole batch."""
    names = ["n", "sizes", "raw"]

    def part(texts: pa.Array, data: np.ndarray, offs: np.ndarray) -> pa.Array:
        ids, counts = tk.encode(texts, path)
        ends = [tk.token_ends(x, data[a:b].tobytes(), path) for x, a, b in zip(np.split(ids, np.cumsum(counts)[:-1]), offs[:-1].tolist(), offs[1:].tolist())]
        sizes = np.concatenate([np.diff(x, prepend=0) for x in ends])
        return pa.StructArray.from_arrays([pa.array(counts + 1), runs.packed(sizes.astype("<u4"), counts), runs.packed(data, np.diff(offs))], names)

    return runs.joined((part(texts[row : row + len(offs) - 1], data, offs) for row, data, offs in tb.slices(texts)), names)


def _encoded(docs: DataFrame, id_col: str, text: str, source: str, path: str, texts: bool) -> DataFrame:
    """(source, id, th, u, n, ids) of the texts with words: ``u`` differs in all rows, ``n`` counts the end token.

    With ``texts`` not the ids but the text (``raw``), the bytes of each token (``sizes``) and the other columns (``rest``).
    """
    width = tk.width(path)
    rest = [c for c in docs.columns if c not in (id_col, text)]

    @F.arrow_udf("struct<n: bigint, ids: binary>")
    def encoded(found: pa.Array) -> pa.Array:
        ids, counts = tk.encode(found, path)
        return pa.StructArray.from_arrays([pa.array(counts + 1), runs.packed(ids.astype(width), counts)], ["n", "ids"])

    @F.arrow_udf("struct<n: bigint, sizes: binary, raw: binary>")
    def sized(found: pa.Array) -> pa.Array:
        return sized_texts(found, path)

    rows = docs.select(F.coalesce(F.col(source).cast("string"), F.lit(NONE)).alias("source"), F.col(id_col).alias("id"), F.col(text).alias("text"), F.struct(*(F.col(c) for c in rest)).alias("rest")).where(F.col("text").rlike(tb.SOLID.pattern))
    rows = rows.select("source", "id", F.xxhash64("text").alias("th"), F.monotonically_increasing_id().alias("u"), *(("rest", sized("text").alias("e")) if texts else (encoded("text").alias("e"),)))
    return written(rows.select(*rows.columns[:-1], "e.*"), "encoded")


def _streams(placed: DataFrame, block: int) -> DataFrame:
    """(source, start, tokens, n): where each source's stream begins among all, its tokens and its blocks."""
    found = placed.groupBy("source").agg(F.min("before").alias("start"), F.sum("n").alias("tokens"))
    return written(found.withColumn("n", F.ceil(F.col("tokens") / block)), "streams")


def plan_slots(streams: DataFrame, weights: dict | None = None, alpha: float = ALPHA, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """(source, block, shard, slot) of every slot, given the (source, tokens, n) of each source."""
    spark = streams.sparkSession
    per = sorted(tuple(r) for r in streams.select("source", "tokens", "n").limit(MOST_SOURCES + 1).collect())
    if len(per) > MOST_SOURCES:
        raise ValueError(f"a mixture has at most {MOST_SOURCES} sources")
    raw = np.array([max(0.0, float((weights or {}).get("" if s == NONE else s, 0))) if weights is not None else float(t) ** alpha for s, t, _ in per])
    slots = int(sum(n for _, _, n in per)) if raw.sum() > 0 else 0
    shares = raw / raw.sum() if slots else raw
    shards = -(-slots // shard_slots) if slots else 0

    def draw(batches):
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for shard in batch.column(0).to_pylist():
                size = min(shard_slots, slots - shard * shard_slots)
                counts = np.random.default_rng([seed, shard]).multinomial(size, shares)
                some = np.flatnonzero(counts)
                for column, x in zip(columns, (np.full(len(some), shard), some, counts[some], (np.cumsum(counts) - counts)[some])):
                    column.append(np.asarray(x, np.int64))
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in columns], names=["shard", "s", "count", "offset"])

    drawn = spark.range(shards).mapInArrow(draw, "shard bigint, s bigint, count bigint, offset bigint")
    drawn, _ = runs.running(drawn, ["s", "shard"], "count", ("offset",))
    first = drawn.groupBy("s").agg(F.min("before").alias("first"))
    known = spark.createDataFrame([(k, s, int(n)) for k, (s, _, n) in enumerate(per)], "s bigint, source string, size bigint")
    taken = drawn.join(first, "s").join(known, "s").withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    k, size = F.col("before") - F.col("first") + F.col("j"), F.col("size")
    here = F.least(F.lit(shard_slots), F.lit(slots) - F.col("shard") * shard_slots).cast("bigint")
    block = _perm(k % size, size, F.xxhash64(F.lit(seed), "source", F.floor(k / size)))
    return taken.select("source", block.alias("block"), "shard", _perm(F.col("offset") + F.col("j"), here, F.xxhash64(F.lit(seed), "shard")).cast("int").alias("slot"))


def _laid_out(rows: DataFrame, placed: DataFrame, total: int, streams: DataFrame) -> tuple[DataFrame, list[int], list[bool]]:
    """(rows in the order of their streams, a part after another; the place of each part's first row in its stream; whether its last stream goes on in the next part)."""
    moved, starts = runs.parted(rows, placed, total, KEYS)
    spark = rows.sparkSession
    heads = spark.createDataFrame([(k, at, first[0]) for k, (at, first) in enumerate(starts)], "k int, at bigint, source string")
    begins = dict(heads.join(streams, "source").select("k", F.col("at") - F.col("start")).collect())  # one row for each part
    return moved, [begins[k] for k in range(len(starts))], [begins.get(k + 1, 0) > 0 for k in range(len(starts))]


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: dict | None = None, alpha: float = ALPHA, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED, path: str = tk.VOCABULARY) -> DataFrame:
    """The mixture's blocks: (shard, slot, source, block, n_tokens, doc_ids, tokens)."""
    width = tk.width(path)
    rows = _encoded(docs, id_col, text, source, path, False)
    placed, total = runs.running(rows, KEYS)
    streams = _streams(placed, block)
    moved, begins, goes_on = _laid_out(rows, placed, total, streams)
    id_kind = rows.schema["id"].dataType
    kind = T.StructType([T.StructField("source", T.StringType()), T.StructField("block", T.LongType()), T.StructField("skip", T.IntegerType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("whole", T.BooleanType()), T.StructField("doc_ids", T.ArrayType(id_kind)), T.StructField("tokens", T.ArrayType(T.BinaryType()))])

    def cut(batches):
        held, owners, size, place, now, part, id_type = [], [], 0, 0, None, None, None

        def blocks(all_of_it: bool, ended: bool):
            """The blocks of what is held; its last, unless it is full or ``all_of_it`` goes, stays."""
            nonlocal held, owners, size, place
            stream, owner = np.concatenate(held), np.repeat(np.arange(len(owners)), [len(x) for x in held])
            edges = np.arange((place // block + 1) * block - place, size, block)
            edges = np.concatenate([[0], edges, [size]]).astype(np.int64)
            full = all_of_it or (place + size) % block == 0
            n = len(edges) - 1 if full else len(edges) - 2
            out: list[list] = [[], [], [], [], []]
            for a, b in zip(edges[:n].tolist(), edges[1 : n + 1].tolist()):
                at = place + a
                whole = at % block == 0 and (b - a == block or (ended and b == size))
                for column, x in zip(out, (at // block, at % block, b - a, whole, owners[owner[a] : owner[b - 1] + 1])):
                    column.append(x)
            left = int(edges[n]) if not full else size
            tokens = runs.packed(stream[:left].astype(width), np.diff(edges[: n + 1]))
            if left < size:
                k = int(owner[left])
                ends = np.cumsum([len(x) for x in held])
                held, owners = [held[k][left - int(ends[k]) :], *held[k + 1 :]], owners[k:]
            else:
                held, owners = [], []
            place, size = place + left, size - left
            names = pa.array([now] * n, pa.string())
            return pa.RecordBatch.from_arrays([names, pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.bool_()), pa.array(out[4], pa.list_(id_type)), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32)), tokens)], names=kind.names)

        for batch in batches:
            id_type = batch.schema.field("id").type
            columns = [batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("part", "source", "id", "ids")]
            for p, s, i, ids in zip(*columns[:3], runs.unpacked(columns[3], width)):
                if p != part or s != now:
                    if size:
                        yield blocks(True, p == part or not goes_on[part])
                    place = begins[p] if p != part else 0
                    part, now = p, s
                held.append(np.append(ids.astype(np.int32), np.int32(tk.END)))
                owners.append(i)
                size += len(held[-1])
                if size >= 128 * block:
                    yield blocks(False, False)
        if size:
            yield blocks(True, not goes_on[part])

    pieces = written(moved.mapInArrow(cut, kind), "pieces")
    drop_written(rows)
    slots = plan_slots(streams, weights, alpha, shard_slots, seed)
    ordered = F.array_sort(F.collect_list(F.struct("skip", "n_tokens", "doc_ids", "tokens")))
    split = pieces.where("NOT whole").groupBy("source", "block").agg(ordered.alias("parts"))  # a few at the ends of each part
    joined = split.select("source", "block", F.aggregate("parts", F.lit(0), lambda acc, x: acc + x["n_tokens"]).alias("n_tokens"), F.flatten("parts.doc_ids").alias("doc_ids"), F.flatten("parts.tokens").alias("tokens"))
    blocks = pieces.where("whole").select(*joined.columns).unionByName(joined)

    @F.arrow_udf("array<int>")
    def as_ints(raw: pa.Array) -> pa.Array:
        parts = runs.unpacked(raw.flatten().to_pylist(), width)  # a block in parts has them in order
        edge = np.concatenate([[0], np.cumsum(list(map(len, parts)))])[np.asarray(raw.offsets) - raw.offsets[0].as_py()]
        return pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.int32()))

    found = slots.hint("merge").join(blocks, ["source", "block"])  # both grow with the corpus
    return found.select("shard", "slot", F.nullif("source", F.lit(NONE)).alias("source"), "block", "n_tokens", "doc_ids", as_ints("tokens").alias("tokens"))


def mix_texts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: dict | None = None, alpha: float = ALPHA, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED, path: str = tk.VOCABULARY) -> DataFrame:
    """The mixture as texts, with the columns of ``docs``: one row for each document's part of each slot, cut at the end of a character.

    Its id is the place of its first token in the mixture, (shard * ``shard_slots`` + slot) * ``block`` + the tokens
    before it in the slot: in the order of the ids, the pieces are the shards, their slots and what these hold.
    """
    rows = _encoded(docs, id_col, text, source, path, True)
    placed, total = runs.running(rows, KEYS)
    streams = _streams(placed, block)
    moved, begins, _ = _laid_out(rows, placed, total, streams)
    kind = T.StructType([T.StructField("source", T.StringType()), T.StructField("block", T.LongType()), T.StructField("at", T.LongType()), T.StructField("piece", T.StringType()), rows.schema["rest"]])

    def cut(batches):
        part, now, place = None, None, 0
        for batch in batches:
            column = lambda x: batch.column(batch.schema.get_field_index(x))  # noqa: B023, E731
            taken: list[int] = []
            out: list[list] = [[], [], [], []]
            for row, (p, s, n, raw, sizes) in enumerate(zip(*(column(x).to_pylist() for x in ("part", "source", "n")), *(runs.unpacked(column(x).to_pylist(), kind_) for x, kind_ in (("raw", "u1"), ("sizes", "<u4"))))):
                if p != part or s != now:
                    place = begins[p] if p != part else 0
                    part, now = p, s
                bounds = np.append(0, np.cumsum(sizes, dtype=np.int64))
                lo = 0
                while lo < n - 1:
                    hi = min(n - 1, (((place + lo) // block) + 1) * block - place)
                    piece = raw[bounds[lo] : bounds[hi]].tobytes().decode()
                    if piece:
                        taken.append(row)
                        for c, x in zip(out, (s, (place + lo) // block, (place + lo) % block, piece)):
                            c.append(x)
                    lo = hi
                place += n
            if taken:
                rest = column("rest").take(pa.array(taken, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string()), rest], names=kind.names)

    pieces = written(moved.mapInArrow(cut, kind), "pieces")
    drop_written(rows)
    slots = plan_slots(streams, weights, alpha, shard_slots, seed)
    found = slots.hint("merge").join(pieces, ["source", "block"])
    first = ((F.col("shard") * shard_slots + F.col("slot")) * block + F.col("at")).alias(id_col)
    return found.select(*(first if c == id_col else F.col("piece").alias(text) if c == text else F.col("rest").getField(c).alias(c) for c in docs.columns))


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture's texts as documents: ids by place in the mixture, n_chars of each part, other columns as they were."""
    out = mix_texts(docs)
    return out.select(*(F.length("text").cast("bigint").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))
