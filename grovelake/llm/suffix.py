"""Operator 4, suffix-array dedup by threshold-bounded interval expansion.

Finds every run of at least ``LENGTH`` words that occurs in two or more documents (words: runs without white
space, ASCII case and closing punctuation folded). One suffix array of the corpus can't be distributed, so its
suffixes are placed by content first: each window of ``LENGTH`` words is owned by the smallest hashed
``GRAM``-word run in it, its anchor; equal windows have equal anchors, so all their suffixes meet in one
partition. Consecutive windows of one anchor form a context. Only anchors of two or more documents go on, and
of equal contexts one stands for all.

A partition lays its contexts out as one text, sorts the suffixes (prefix doubling, to at least LENGTH words),
takes the Burrows-Wheeler transform and extends intervals backwards, breadth first: the round of value l turns
each interval of a word string w, for each word c before it, into that of cw; where the end of that has no
common-prefix value yet it becomes l and the interval is queued. Values come in increasing order, and the rounds
stop at LENGTH: ends without a value share at least LENGTH words with their neighbour.

Defined results: null, blank and short texts have no run. Rows of one id are one document: what repeats only
within it (or between rows of equal id) is not reported. Rows without an id are one document of null id.
Spans that overlap or touch are merged; rows that repeat an id and its text have one. Ids may be of any type: those
that are no integers are told apart by a 64-bit hash. Other columns are not read, whatever their names.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import IntegralType

from . import textbuf as tb
from .store import drop_written, written

LENGTH, GRAM = 50, 16
NULL_ID = -(2**63)
CHUNK_WORDS = 400_000
U64 = np.uint64
ANCHORS = "doc bigint, th bigint, anchor bigint, ctx bigint, start int, n int"
ANCHORS_OUT = pa.schema([("doc", pa.int64()), ("th", pa.int64()), ("anchor", pa.int64()), ("ctx", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])
CONTENT = "anchor bigint, ctx bigint, least bigint, most bigint, words binary"
CONTENT_OUT = pa.schema([("anchor", pa.int64()), ("ctx", pa.int64()), ("least", pa.int64()), ("most", pa.int64()), ("words", pa.binary())])
FOUND = "anchor bigint, ctx bigint, off int, run int"
FOUND_OUT = pa.schema([("anchor", pa.int64()), ("ctx", pa.int64()), ("off", pa.int32()), ("run", pa.int32())])


def _ranges(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray, down: np.ndarray) -> np.ndarray:
    return tb.mix((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(U64))


def contexts(h: np.ndarray, first: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, anchor, context hash, first window's word within the text, windows) of texts' word hashes."""
    none = tuple(np.zeros(0, k) for k in (np.int64, U64, U64, np.int64, np.int64))
    windows = len(h) - length + 1
    if windows < 1:
        return none
    up, down = tb._powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, U64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    at = np.arange(len(h) - gram + 1)
    least, place, have, wide = _ranges(sums, at, at + gram, down), at, 1, length - gram + 1
    while have < wide:
        step = min(have, wide - have)
        right = least[step:] < least[: len(least) - step]
        place = np.where(right, place[step:], place[: len(least) - step])
        least = np.where(right, least[step:], least[: len(least) - step])
        have += step
    size = np.diff(first)
    text = np.repeat(np.arange(len(size)), size)[:windows]
    ok = np.arange(windows) + length <= first[1:][text]
    s = np.flatnonzero(ok)
    if not len(s):
        return none
    new = np.concatenate([[True], (place[s[1:]] != place[s[:-1]]) | (s[1:] != s[:-1] + 1) | (text[s[1:]] != text[s[:-1]])])
    lo = s[new]
    n = np.diff(np.append(np.flatnonzero(new), len(s)))
    return text[lo], least[lo], _ranges(sums, lo, lo + n - 1 + length, down), lo - first[text[lo]], n


def suffix_order(words: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` words or more, ties by place."""
    rank = words.astype(np.int64)
    n, have = len(words), 1
    order = np.argsort(rank, kind="stable")
    while have < depth:
        after = np.zeros(n, np.int64)
        after[: n - have] = rank[have:] + 1
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            break
        have *= 2
    return order


def bounded_lcp(words: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it, in suffix order; ``length`` where it is that or more."""
    n = len(words)
    bwt = words[order - 1]  # the text is a ring: its last word is a separator of its own
    by_word = np.argsort(bwt, kind="stable")
    lf = np.empty(n, np.int64)
    lf[by_word] = np.arange(n)
    value = np.full(n + 1, -1, np.int64)
    value[0] = value[n] = 0
    lo, hi = np.array([0]), np.array([n])
    for level in range(length):
        size = hi - lo
        owner = np.repeat(np.arange(len(lo)), size)
        at = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
        to = lf[at]
        by = np.argsort(to, kind="stable")
        to, owner, word = to[by], owner[by], bwt[at[by]]
        new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (word[1:] != word[:-1])])
        begin = to[new]
        end = begin + np.diff(np.append(np.flatnonzero(new), len(to)))
        fresh = value[end] < 0
        value[end[fresh]] = level
        # the first and last interval of a round end where the array does: they are queued by their begin
        edge = (end == n) & (begin > 0)
        keep = fresh | edge | (end - begin == n)
        lo, hi = begin[keep], end[keep]
        if not fresh.any() and level:
            break
    value[value < 0] = length
    return value[:n]


def repeated_windows(parts: list[np.ndarray], least: np.ndarray, most: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(part, offset) of every window of ``length`` words that parts of two or more documents have."""
    sizes = np.array([len(p) for p in parts])
    values, ids = np.unique(np.concatenate(parts), return_inverse=True)
    owner = np.repeat(np.arange(len(parts)), sizes)
    place = np.arange(len(ids)) + owner  # each part is followed by a separator of its own
    words = np.empty(len(ids) + len(parts), np.int64)
    words[place] = ids
    ends = np.cumsum(sizes + 1) - 1
    words[ends] = len(values) + np.arange(len(parts))
    order = suffix_order(words, length)
    lcp = bounded_lcp(words, order, length)
    heads = np.flatnonzero(lcp < length)
    part = np.searchsorted(ends, order)
    off = order - (ends[part] - sizes[part])
    group_least = np.minimum.reduceat(least[part], heads)
    group_most = np.maximum.reduceat(most[part], heads)
    size = np.diff(np.append(heads, len(order)))
    shared = np.repeat((size > 1) & (group_least != group_most), size) & (off + length <= sizes[part])
    return part[shared], off[shared]


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, th, start_word, end_word): what each row shares with other documents; th is a hash of its text."""

    def anchors(batches):
        for batch in batches:
            doc, th = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for row, data, offs in tb.slices(batch.column(2)):
                starts, ends, first = tb.words(data, offs)
                which, anchor, ctx, start, n = contexts(tb.word_hashes(data, starts, ends), first, length, gram)
                yield pa.RecordBatch.from_arrays([pa.array(doc[row + which]), pa.array(th[row + which]), pa.array(anchor.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], schema=ANCHORS_OUT)

    def content(batches):
        for batch in batches:
            lists = batch.column(1)
            per = np.diff(np.asarray(lists.offsets))
            flat = lists.flatten()
            anchor, ctx, start, n, least, most = (np.asarray(flat.field(k)) for k in range(6))
            edge = np.concatenate([[0], np.cumsum(per)])
            for row, data, offs in tb.slices(batch.column(0)):
                starts, ends, first = tb.words(data, offs)
                short = (tb.word_hashes(data, starts, ends) >> U64(32)).astype(np.uint32)
                a, b = edge[row], edge[row + len(first) - 1]
                lo = np.repeat(first[:-1], per[row : row + len(first) - 1]) + start[a:b]
                words = [short[x : x + m].tobytes() for x, m in zip(lo.tolist(), (n[a:b] + length - 1).tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(anchor[a:b]), pa.array(ctx[a:b]), pa.array(least[a:b]), pa.array(most[a:b]), pa.array(words, pa.binary())], schema=CONTENT_OUT)

    def search(batches):
        held, n_words = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            for at in range(0, batch.num_rows, 2000):
                now = pa.Table.from_batches([batch.slice(at, 2000)])
                held = now if held is None else pa.concat_tables([held, now])
                n_words += now["words"].nbytes // 4
                if n_words < CHUNK_WORDS:
                    continue
                key = np.asarray(held["anchor"])
                ends = np.flatnonzero(key[1:] != key[:-1])
                if len(ends):  # the last anchor may go on
                    cut = int(ends[-1]) + 1
                    yield found(held.slice(0, cut))
                    held = held.slice(cut).combine_chunks()
                    n_words = held["words"].nbytes // 4
        if held is not None:
            yield found(held)

    def found(rows):
        parts = [np.frombuffer(x.as_buffer(), np.uint32) for c in rows["words"].chunks for x in c]
        part, off = repeated_windows(parts, np.asarray(rows["least"]), np.asarray(rows["most"]), length)
        by = np.lexsort((off, part))
        part, off = part[by], off[by]
        new = np.concatenate([[True], (part[1:] != part[:-1]) | (off[1:] != off[:-1] + 1)]) if len(part) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        run = np.diff(np.append(head, len(part)))
        anchor, ctx = np.asarray(rows["anchor"]), np.asarray(rows["ctx"])
        return pa.RecordBatch.from_arrays([pa.array(anchor[part[head]]), pa.array(ctx[part[head]]), pa.array(off[head].astype(np.int32)), pa.array(run.astype(np.int32))], schema=FOUND_OUT)

    own = F.col(id_col) if isinstance(docs.schema[id_col].dataType, IntegralType) else F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col).cast("string")))
    rows = docs.select(F.coalesce(own.cast("bigint"), F.lit(NULL_ID)).alias("doc"), F.xxhash64(text).alias("th"), F.col(text).alias("text"), F.col(id_col).alias("id")).where("text IS NOT NULL")
    ids = rows.select("doc", "th", "id").distinct()
    rows = rows.select("doc", "th", "text")
    all_anchors = written(rows.mapInArrow(anchors, ANCHORS), "all-anchors")
    many = all_anchors.groupBy("anchor").agg(F.min("doc").alias("a0"), F.max("doc").alias("a1")).where("a0 <> a1").select("anchor")
    shared = written(all_anchors.join(many, "anchor"), "anchors")
    drop_written(all_anchors)
    head = F.min(F.struct("doc", "th", "start", "n")).alias("head")
    of_context = written(shared.groupBy("anchor", "ctx").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), head), "contexts")
    open_ = of_context.where("least = most").select("anchor").distinct()  # all contexts of an anchor with such a one are compared
    in_list = F.struct("anchor", "ctx", F.col("head.start").alias("start"), F.col("head.n").alias("n"), "least", "most")
    needed = of_context.join(open_, "anchor", "left_semi").groupBy(F.col("head.doc").alias("doc"), F.col("head.th").alias("th")).agg(F.collect_list(in_list).alias("list"))
    shared = shared.join(of_context.select("anchor", "ctx", "least", "most"), ["anchor", "ctx"])
    texts = rows.join(needed, ["doc", "th"]).select("text", "list").mapInArrow(content, CONTENT)
    placed = texts.repartition("anchor").sortWithinPartitions("anchor")
    part = placed.mapInArrow(search, FOUND)
    opened = shared.where("least = most").join(part, ["anchor", "ctx"]).select("doc", "th", (F.col("start") + F.col("off")).alias("lo"), (F.col("start") + F.col("off") + F.col("run") + (length - 1)).alias("hi"))
    whole = shared.where("least <> most").select("doc", "th", F.col("start").alias("lo"), (F.col("start") + F.col("n") + (length - 1)).alias("hi"))
    spans = opened.union(whole).distinct()
    before = W.partitionBy("doc", "th").orderBy("lo", "hi")
    islands = spans.withColumn("reach", F.max("hi").over(before.rowsBetween(W.unboundedPreceding, -1)))
    numbered = islands.withColumn("island", F.sum(F.when(F.col("lo") <= F.col("reach"), 0).otherwise(1)).over(before.rowsBetween(W.unboundedPreceding, 0)))
    merged = numbered.groupBy("doc", "th", "island").agg(F.min("lo").alias("start_word"), F.max("hi").alias("end_word"))
    if isinstance(docs.schema[id_col].dataType, IntegralType):
        return merged.select(F.when(F.col("doc") != NULL_ID, F.col("doc")).alias("doc_id"), "th", "start_word", "end_word")
    return merged.join(ids, ["doc", "th"]).select(F.col("id").alias("doc_id"), "th", "start_word", "end_word")


def op4_suffix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return repeated_spans(docs).select("doc_id", "start_word", "end_word")
