"""Text search: chunkers, embedders, an index as a table of chunk vectors, cascades from values and audits."""

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .nearest import BLOCK, nearest, packed
from .vector import exact_knn


def identity_chunks(text: Column) -> Column:
    return F.array(text)


def line_chunks(text: Column) -> Column:
    """Lines that aren't empty."""
    return F.filter(F.split(text, "\n"), lambda x: x != "")


@dataclass(frozen=True)
class Embedder:
    """An expression of the text and what tells two embedders apart."""

    id: str
    version: str
    dim: int
    embed: Callable[[Column], Column]


def hash_embedder(dim: int = 32, seed: int = 0) -> Embedder:
    """Element i is the first byte, signed, over 128, of SHA-256(seed, i, text); the vector is normalised. Over Arrow batches, a text once in each."""
    heads = [seed.to_bytes(8, "little") + i.to_bytes(4, "little") for i in range(dim)]

    @F.arrow_udf("array<float>")
    def embed(texts: pa.Array) -> pa.Array:
        coded = texts.dictionary_encode()
        said = coded.dictionary.cast(pa.binary()).to_pylist()
        first = bytes(hashlib.sha256(head + t).digest()[0] for t in said for head in heads)
        raw = np.frombuffer(first, np.int8).reshape(len(said), dim) / 128.0
        norm = np.sqrt((raw * raw).sum(1, keepdims=True))  # of multiples of 2^-14: exact in any order
        flat = pa.array((raw / np.where(norm > 0, norm, 1)).astype(np.float32).ravel())
        made = pa.ListArray.from_arrays(pa.array(np.arange(len(said) + 1) * dim, pa.int32()), flat)
        return made.take(coded.indices)

    return Embedder("hash", f"1:{seed}", dim, embed)


def callable_embedder(fn: Callable[[list[str]], list], id_: str, version: str, dim: int) -> Embedder:
    """A Python function of a batch of texts, run over Arrow batches."""

    @F.arrow_udf("array<float>")
    def embed(texts: pa.Array) -> pa.Array:
        out = fn(texts.to_pylist())
        if any(len(v) != dim for v in out):
            raise ValueError(f"the embedder must give {dim} elements")
        return pa.array([np.asarray(v, np.float32).tolist() for v in out], pa.list_(pa.float32()))

    return Embedder(id_, version, dim, embed)


def embedded(docs: DataFrame, embedder: Embedder, chunks: Callable[[Column], Column] = line_chunks) -> DataFrame:
    """(doc_id, chunk_idx, vector) of the chunks of (doc_id, text)."""
    rows = docs.where("text IS NOT NULL").select("doc_id", F.posexplode(chunks(F.col("text"))).alias("chunk_idx", "chunk"))
    return rows.select("doc_id", "chunk_idx", embedder.embed(F.col("chunk")).alias("vector"))


def same_embedder(a: Embedder, described: dict) -> None:
    """Refuses an index that another embedder made."""
    for name in ("id", "version", "dim"):
        if getattr(a, name) != described[name]:
            raise ValueError(f"the index was made by an embedder of another {name}: {described[name]!r}")


def put_documents(index: DataFrame, docs: DataFrame, embedder: Embedder, chunks: Callable[[Column], Column] = line_chunks) -> DataFrame:
    """The index with these documents' chunks in place of their old ones."""
    return index.join(docs.select("doc_id"), "doc_id", "left_anti").unionByName(embedded(docs, embedder, chunks))


def drop_documents(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids.select("doc_id"), "doc_id", "left_anti")


def search(index: DataFrame, queries: DataFrame, k: int, embedder: Embedder, metric: str = "cosine") -> DataFrame:
    """(qid, doc_id, score, rank) of each (qid, text): a document counts by its nearest chunk; ties by doc_id."""
    asked = queries.select("qid", embedder.embed(F.col("text")).alias("query"))
    blocks = packed(index.select(F.col("doc_id").alias("id"), "vector"), k)
    found = nearest(asked, blocks, index.schema["vector"].dataType, k, metric, -(-max(1, queries.count()) // BLOCK))
    best = found.groupBy("qid", F.col("id").alias("doc_id")).agg(F.min("distance").alias("score"))
    return best.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("score", "doc_id"))).where(F.col("rank") <= k)


def nearest_chunks(index: DataFrame, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """The k nearest chunks of each (qid, query vector)."""
    keyed = index.select(F.struct("doc_id", "chunk_idx").alias("id"), "vector")
    return exact_knn(queries, keyed, k, metric).select("qid", "id.doc_id", "id.chunk_idx", "distance", "rank")


def cascade(rows: DataFrame, transform: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """((doc_id, text) to index of (key, value), one row (indexed, skipped)): null of the transform and bytes that are no UTF-8 are skipped."""
    if transform is None:
        text = F.when(F.is_valid_utf8(F.col("value").cast("string")), F.col("value").cast("string"))
    else:
        text = transform(F.col("value"))
    made = rows.select(F.col("key").alias("doc_id"), text.alias("text"))
    report = made.agg(F.count("text").alias("indexed"), (F.count("*") - F.count("text")).alias("skipped"))
    return made.where("text IS NOT NULL"), report


def audit(primary: DataFrame, index: DataFrame) -> DataFrame:
    """(doc_id, problem): orphan (only in the index) or missing (only in the primary table)."""
    a, b = primary.select("doc_id").distinct(), index.select("doc_id").distinct()
    return b.join(a, "doc_id", "left_anti").select("doc_id", F.lit("orphan").alias("problem")).unionByName(a.join(b, "doc_id", "left_anti").select("doc_id", F.lit("missing").alias("problem")))


def purge_orphans(primary: DataFrame, index: DataFrame) -> tuple[DataFrame, int]:
    """(the index without orphans, how many documents were dropped)."""
    kept = index.join(primary.select("doc_id"), "doc_id", "left_semi")
    return kept, index.select("doc_id").distinct().count() - kept.select("doc_id").distinct().count()
