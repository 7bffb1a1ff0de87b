"""Operator 7, packing by order-preserving dynamic programming.

Documents keep the order of their ids. They are tokenised whole, each document closed by an end token,
and cut into windows of at most ``WINDOW`` tokens. A cut lies at the end of a document (free) or of a
sentence (after a line end or ``. ! ?`` and white space; ``CUT_PENALTY``); a sentence longer than a window may also be cut every ``WINDOW // 8`` tokens
(``SPLIT_PENALTY``). The cuts minimise padding plus penalties: with S the running token count,
f(j) = min over i of f(i) + WINDOW - (S(j) - S(i)) + penalty(j), where S(j) - S(i) <= WINDOW; the minimum of
f(i) + S(i) over that sliding range is the front of a monotone queue, so that the time is linear.

The stream of all documents is packed in runs: a run holds the documents that begin in one stretch of ``RUN``
tokens, so the work is parallel, a task holds one run at a time, and only the last window of each run is padded
for that. How ids are spread doesn't matter. A run is as long as its documents: one longer than ``RUN`` is whole.

Defined results: ids may be of any type that sorts. Null and blank texts give no tokens and appear in no window;
an empty table gives no window. Rows of one id follow each other by a hash of the text, repeated rows are each
packed; rows without an id come last, by that hash. Columns that are not used are not read.
"""

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import runs
from . import textbuf as tb
from . import tokens as tk
from .store import written

WINDOW, RUN = 2048, 1 << 20
CUT_PENALTY, SPLIT_PENALTY = 64, 512
_SPACE, _FINAL = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FINAL[[10, ord("."), ord("!"), ord("?")]] = True
NAMES = ("window", "doc_ids", "n_tokens", "padding", "cut", "tokens")
KINDS = np.array(["document", "sentence", "split"])
KEYS = ["id", "th", "u"]


def best_cuts(sizes: list[int], penalties: list[int], window: int) -> tuple[list[int], int]:
    """Ends (exclusive) of the windows over units of these sizes, and the cost; each size is at most window."""
    total = [0]
    for x in sizes:
        total.append(total[-1] + x)
    n = len(sizes)
    cost, back = [0] * (n + 1), [0] * (n + 1)
    queue: deque = deque()
    for j in range(1, n + 1):
        i = j - 1
        value = cost[i] + total[i]
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, i))
        least = total[j] - window
        while total[queue[0][1]] < least:
            queue.popleft()
        value, i = queue[0]
        cost[j], back[j] = value + window - total[j] + penalties[j - 1], i
    cuts, j = [], n
    while j:
        cuts.append(j)
        j = back[j]
    return cuts[::-1], cost[n]


def _slice_units(texts: pa.Array, data: np.ndarray, offs: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids, counts = tk.encode(texts, path)
    size = tk.sizes(path)[ids]
    edge = np.concatenate([[0], np.cumsum(counts)])
    total = np.concatenate([[0], np.cumsum(size)])
    byte_end = total[1:] + np.repeat(offs[:-1] - total[edge[:-1]] - 1, counts)
    for d in np.flatnonzero(total[edge[1:]] - total[edge[:-1]] - 1 != np.diff(offs)).tolist():
        byte_end[edge[d] : edge[d + 1]] = offs[d] + tk.token_ends(ids[edge[d] : edge[d + 1]], data[offs[d] : offs[d + 1]].tobytes(), path)
    space, final = _SPACE[data], _FINAL[data]
    soft = space | final
    turn = np.flatnonzero(np.diff(soft.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    inner = np.unique(offs[(offs > 0) & (offs < len(data))])
    inner = inner[soft[inner - 1] & soft[inner]]  # what a text begins with doesn't go on from the text before it
    begin, end = np.sort(np.append(turn[::2], inner)), np.sort(np.append(turn[1::2], inner))
    spaces, finals = np.cumsum(space, dtype=np.int32), np.cumsum(final, dtype=np.int32)
    last = end - 1
    end = end[(spaces[last] - spaces[begin] + space[begin] > 0) & (finals[last] - finals[begin] + final[begin] > 0)]
    end = end - (data[end - 1] == 32)  # a space is the first byte of the word after it
    cuts = np.unique(np.concatenate([np.searchsorted(byte_end, end, "right"), edge[1:]]))
    cuts = cuts[cuts > 0]
    own = np.searchsorted(edge, cuts, "left") - 1
    sentences = np.diff(cuts, prepend=0) + (cuts == edge[own + 1])
    each = np.bincount(own, minlength=len(counts))
    bare = np.flatnonzero(each == 0)  # a text without tokens is its end token
    sentences = np.insert(sentences, (np.cumsum(each) - each)[bare], 1)
    each[bare] = 1
    return ids, counts, sentences, each


def unit_slices(texts: pa.Array, path: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """What ``units`` gives, for a bounded number of bytes of texts after another (a longer text alone)."""
    for row, data, offs in tb.slices(texts):
        yield _slice_units(texts[row : row + len(offs) - 1], data, offs, path)


def units(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens of all texts, number of each text, sizes of all sentences, number of each text); the last sentence of a text counts its end token."""
    parts = list(unit_slices(texts, path))
    return tuple(map(np.concatenate, zip(*parts))) if parts else (np.zeros(0, np.int64),) * 4


def pack_units(ids: list, parts: list[np.ndarray], sentences: list[np.ndarray], window: int = WINDOW, cut: int = CUT_PENALTY, split: int = SPLIT_PENALTY) -> dict:
    """The windows of one run: documents in order, each with its tokens and the sizes of its sentences."""
    rows: dict = {name: [] for name in NAMES}
    if not ids:
        return rows
    each = np.array(list(map(len, sentences)))
    sizes, owner = np.concatenate(sentences).astype(np.int64), np.repeat(np.arange(len(ids)), each)
    closing = np.zeros(len(sizes), bool)
    closing[np.cumsum(each) - 1] = True
    length = np.array(list(map(len, parts)))
    stream = np.full(int(length.sum()) + len(ids), tk.END, np.int32)
    stream[np.arange(int(length.sum())) + np.repeat(np.arange(len(ids)), length)] = np.concatenate(parts)
    step = max(1, window // 8)
    pieces = np.where(sizes > window, -(-sizes // step), 1)
    which = np.repeat(np.arange(len(sizes)), pieces)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    final = nth == pieces[which] - 1
    kind = np.where(~final, 2, np.where(closing[which], 0, 1))
    sizes = np.where(pieces[which] == 1, sizes[which], np.where(final, sizes[which] - step * (pieces[which] - 1), step))
    used = sizes > 0
    sizes, kind, which = sizes[used], kind[used], which[used]
    cuts, _ = best_cuts(sizes.tolist(), np.array([0, cut, split])[kind].tolist(), window)
    docs, total = owner[which], np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    for k, to in enumerate(cuts):
        seen = docs[at:to]
        seen = seen[np.concatenate([[True], seen[1:] != seen[:-1]])]
        used_here = int(total[to] - total[at])
        for name, x in zip(NAMES, (k, [ids[d] for d in seen], used_here, window - used_here, str(KINDS[kind[to - 1]]), stream[total[at] : total[to]])):
            rows[name].append(x)
        at = to
    return rows


def pack_run(ids: list, texts: list, window: int = WINDOW, cut: int = CUT_PENALTY, split: int = SPLIT_PENALTY, path: str = tk.VOCABULARY) -> dict:
    """The windows of one run of texts that are in order."""
    kept = [k for k, text in enumerate(texts) if text and tb.SOLID.search(text)]
    flat, counts, sentences, each = units(pa.array([texts[k] for k in kept], pa.large_string()), path)
    cut_up = lambda x, n: np.split(x, np.cumsum(n)[:-1]) if len(n) else []
    return pack_units([ids[k] for k in kept], cut_up(flat, counts), cut_up(sentences, each), window, cut, split)


def encoded_texts(texts: pa.Array, path: str) -> pa.Array:
    """(n, ids, sentences) of each text, compressed a slice at a time: a task never holds the tokens of a whole batch."""
    width, names = tk.width(path), ["n", "ids", "sentences"]
    return runs.joined((pa.StructArray.from_arrays([pa.array(counts + 1), runs.packed(flat.astype(width), counts), runs.packed(sentences.astype("<i4"), each)], names) for flat, counts, sentences, each in unit_slices(texts, path)), names)


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, run: int = RUN, cut: int = CUT_PENALTY, split: int = SPLIT_PENALTY, path: str = tk.VOCABULARY) -> DataFrame:
    """Windows of ``docs``: (run, window, doc_ids, n_tokens, padding, cut, tokens)."""
    width = tk.width(path)

    @F.arrow_udf("struct<n: bigint, ids: binary, sentences: binary>")
    def encoded(texts: pa.Array) -> pa.Array:
        return encoded_texts(texts, path)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where(F.col("text").rlike(tb.SOLID.pattern))
    rows = rows.select("id", F.xxhash64("text").alias("th"), F.monotonically_increasing_id().alias("u"), encoded("text").alias("e")).select("id", "th", "u", "e.*")
    rows = written(rows, "encoded")
    placed, total = runs.running(rows, KEYS)
    moved, starts = runs.parted(rows, placed, total, KEYS, run)
    begins = [at for at, _ in starts]
    kind = T.StructType([T.StructField("run", T.LongType()), T.StructField("window", T.IntegerType()), T.StructField("doc_ids", T.ArrayType(rows.schema["id"].dataType)), *T._parse_datatype_string("n_tokens int, padding int, cut string, tokens array<int>").fields])

    def windows(batches):
        held: tuple = ([], [], [])
        part, at, now, id_type = None, 0, None, None

        def flush():
            found = pack_units(*held, window, cut, split)
            for x in held:
                x.clear()
            n = len(found["window"])
            edge = np.concatenate([[0], np.cumsum(found["n_tokens"])]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(edge), pa.array(np.concatenate(found["tokens"])))
            return pa.RecordBatch.from_arrays([pa.array([now] * n, pa.int64()), pa.array(found["window"], pa.int32()), pa.array(found["doc_ids"], pa.list_(id_type)), pa.array(found["n_tokens"], pa.int32()), pa.array(found["padding"], pa.int32()), pa.array(found["cut"], pa.string()), tokens], names=kind.names)

        for batch in batches:
            id_type = batch.schema.field("id").type
            columns = [batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("part", "id", "n", "ids", "sentences")]
            for p, i, n, ids, sentences in zip(*columns[:3], runs.unpacked(columns[3], width), runs.unpacked(columns[4], "<i4")):
                if p != part:
                    part, at = p, begins[p]
                if at // run != now:
                    if held[0]:
                        yield flush()
                    now = at // run
                at += n
                for column, x in zip(held, (i, ids, sentences)):
                    column.append(x)
        if held[0]:
            yield flush()

    return moved.mapInArrow(windows, kind)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture's pieces in the order of their ids, which are places in the mixture."""
    return pack(docs)
