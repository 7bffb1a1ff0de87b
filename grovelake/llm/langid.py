"""Operator 1, language identification by a byte convolutional network.

A text is cut into windows of ``WINDOW`` bytes (the last is padded), ASCII and Latin-1 capitals folded and
whatever is no letter set to 0. Bytes are embedded, convolved with filters of several ``WIDTHS``, each filter
is pooled to its maximum over the window, and a softmax layer gives the window's probabilities. A text's
probabilities are the mean over all its windows, weighted by their letters. The network is trained in numpy
with Adam on all windows of at most ``max_labelled`` labelled rows, those of the smallest hashed keys.

Defined results: a null text and one without a letter have no language: ``lang_pred`` and ``lang_p`` are null.
Of equal probabilities the language that sorts first wins. Without labelled rows every language is null; with
one label only, that label is every text's. The rows to train on are chosen by a hash of id and text, so null,
equal and repeated ids don't add any. Each row is on its own, so repeated rows get equal results.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbuf as tb

WINDOW, WIDTHS, FILTERS, EMBED = 256, (3, 4, 5), 16, 6
MAX_LABELLED = 4000
CHUNK = 64  #: windows that are convolved at once
_FOLD = np.zeros(256, np.uint8)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)


@dataclass
class ByteNet:
    languages: list[str]
    embed: np.ndarray
    kernels: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray


def fold(data: np.ndarray) -> np.ndarray:
    """Bytes without case; 0 for all that is no letter."""
    low = _FOLD[data]
    if len(data) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        low[1:][capital] += 0x20
    return low


def windows(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows, first window of each text and the end) of folded texts."""
    size = np.diff(offs)
    first = np.concatenate([[0], np.cumsum(-(-size // WINDOW))])
    out = np.zeros(int(first[-1]) * WINDOW, np.uint8)
    if len(data):
        out[np.arange(len(data)) + np.repeat(first[:-1] * WINDOW - offs[:-1], size)] = fold(data)
    return out.reshape(-1, WINDOW), first


def _columns(x: np.ndarray, width: int) -> np.ndarray:
    n, length, depth = x.shape
    s = x.strides
    return np.lib.stride_tricks.as_strided(x, (n, length - width + 1, width * depth), (s[0], s[1], s[2]))


def probabilities(net: ByteNet, seen: np.ndarray) -> np.ndarray:
    """(windows, languages)."""
    out = np.zeros((len(seen), len(net.languages)), np.float32)
    for at in range(0, len(seen), CHUNK):
        x = net.embed[seen[at : at + CHUNK]]
        pooled = []
        for width, kernel, bias in zip(WIDTHS, net.kernels, net.biases):
            cols = _columns(x, width)
            found = (cols.reshape(-1, cols.shape[2]) @ kernel).reshape(len(x), cols.shape[1], FILTERS)
            pooled.append(np.maximum(found.max(1) + bias, 0))
        z = np.concatenate(pooled, 1) @ net.out + net.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        out[at : at + len(x)] = z / z.sum(1, keepdims=True)
    return out


def classify(net: ByteNet, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(place of the language, probability) of each text; -1 where it has no letter."""
    best, p = np.full(len(texts), -1), np.zeros(len(texts))
    for row, data, offs in tb.slices(texts):
        seen, first = windows(data, offs)
        if not len(seen):
            continue
        letters = (seen != 0).sum(1).astype(np.float64)
        some = np.flatnonzero(letters)
        weighted = np.zeros((len(seen) + 1, len(net.languages)))
        weighted[1:][some] = probabilities(net, seen[some]) * letters[some, None]
        total, mass = np.cumsum(weighted, axis=0), np.concatenate([[0], np.cumsum(letters)])
        have = mass[first[1:]] - mass[first[:-1]]
        mean = (total[first[1:]] - total[first[:-1]]) / np.maximum(have, 1)[:, None]
        best[row : row + len(have)] = np.where(have > 0, mean.round(6).argmax(1), -1)
        p[row : row + len(have)] = mean.max(1)
    return best, p


def fit(seen: np.ndarray, labels: list[str], epochs: int = 4, batch: int = 128, seed: int = 3) -> ByteNet | None:
    """Trained on windows with their labels; None without any."""
    languages = sorted(set(labels))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    y = np.searchsorted(languages, labels)
    f32 = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    params = [f32(256, EMBED, scale=0.5)]
    params += [f32(w * EMBED, FILTERS, scale=(2 / (w * EMBED)) ** 0.5) for w in WIDTHS]
    params += [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    params += [f32(FILTERS * len(WIDTHS), len(languages), scale=0.2), np.zeros(len(languages), np.float32)]
    params[0][0] = 0
    m, v = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    step, n_w = 0, len(WIDTHS)
    for _ in range(epochs if len(languages) > 1 else 0):
        order = rng.permutation(len(seen))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            ids = seen[rows]
            x = params[0][ids]
            grads = [np.zeros_like(p) for p in params]
            pooled, where = [], []
            for k, width in enumerate(WIDTHS):
                cols = _columns(x, width)
                found = (cols.reshape(-1, cols.shape[2]) @ params[1 + k]).reshape(len(x), cols.shape[1], FILTERS)
                top = found.argmax(1)
                where.append(top)
                pooled.append(np.take_along_axis(found, top[:, None], 1)[:, 0] + params[1 + n_w + k])
            flat = np.concatenate(pooled, 1)
            hidden = np.maximum(flat, 0)
            z = hidden @ params[-2] + params[-1]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            grads[-2], grads[-1] = hidden.T @ p, p.sum(0)
            back = (p @ params[-2].T) * (flat > 0)
            for k, width in enumerate(WIDTHS):
                g = back[:, k * FILTERS : (k + 1) * FILTERS]
                grads[1 + n_w + k] = g.sum(0)
                at_bytes = where[k][:, :, None] + np.arange(width)
                picked = ids[np.arange(len(ids))[:, None, None], at_bytes]
                held = params[0][picked].reshape(len(ids), FILTERS, -1)
                grads[1 + k] = np.einsum("bf,bfk->kf", g, held)
                into = g[:, :, None] * params[1 + k].T[None]
                flat = into.reshape(-1, EMBED)
                for e in range(EMBED):
                    grads[0][:, e] += np.bincount(picked.ravel(), flat[:, e], 256)
            grads[0][0] = 0
            step += 1
            for k, x_ in enumerate(params):
                m[k] += 0.1 * (grads[k] - m[k])
                v[k] += 0.01 * (grads[k] ** 2 - v[k])
                x_ -= 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
    return ByteNet(languages, params[0], params[1 : 1 + n_w], params[1 + n_w : 1 + 2 * n_w], params[-2], params[-1])


def _all_windows(texts: pa.Array) -> pa.Array:
    """The windows of every text that hold a letter."""
    out: list = []
    for _, data, offs in tb.slices(texts):
        seen, first = windows(data, offs)
        some = seen.any(1)
        out.extend([seen[i].tobytes() for i in range(a, b) if some[i]] for a, b in zip(first[:-1].tolist(), first[1:].tolist()))
    return pa.array(out, pa.list_(pa.binary()))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", max_labelled: int = MAX_LABELLED) -> ByteNet | None:
    """Trained on all windows of at most ``max_labelled`` rows with a language and a text."""

    @F.arrow_udf("array<binary>")
    def drawn(texts: pa.Array) -> pa.Array:
        return _all_windows(texts)

    rows = docs.select(F.col(lang).cast("string").alias("y"), F.col(text).alias("t"), F.xxhash64(F.col(id_col).cast("string"), text).alias("h")).where("y IS NOT NULL AND t IS NOT NULL")
    n = rows.count()
    if not n:
        return None
    least = min((1 << 63) - 1, -(1 << 63) + int(2 * max_labelled / n * (1 << 64)))  # twice as many rows as are wanted are sorted, not all
    first = lambda near: near.orderBy("h", "y").limit(max_labelled).select("h", "y", drawn("t").alias("w")).collect()
    chosen = first(rows.where(F.col("h") <= least))
    if len(chosen) < min(n, max_labelled):  # few different rows
        chosen = first(rows)
    found = sorted((r.h, r.y, bytes(w)) for r in chosen for w in r.w)
    return fit(np.frombuffer(b"".join(w for _, _, w in found), np.uint8).reshape(-1, WINDOW), [y for _, y, _ in found])


def language(net: ByteNet, text: Column, spark: SparkSession) -> Column:
    """Struct (lang, p) of the most probable language."""
    shared = spark.sparkContext.broadcast(net)

    @F.arrow_udf("struct<lang: string, p: double>")
    def guess(texts: pa.Array) -> pa.Array:
        best, p = classify(shared.value, texts)
        names = pa.array([None if k < 0 else shared.value.languages[k] for k in best.tolist()], pa.string())
        return pa.StructArray.from_arrays([names, pa.array(p, pa.float64(), mask=best < 0)], ["lang", "p"])

    return guess(text)


def identify(docs: DataFrame, net: ByteNet | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_p``; columns of those names are replaced."""
    if net is None:
        return docs.withColumns({"lang_pred": F.lit(None).cast("string"), "lang_p": F.lit(None).cast("double")})
    names = [c for c in docs.columns if c not in ("lang_pred", "lang_p")]
    out = docs.select(*names, language(net, F.col(text), docs.sparkSession).alias("__guess"))
    return out.select(*names, F.col("__guess.lang").alias("lang_pred"), F.col("__guess.p").alias("lang_p"))


def op1_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs, train(docs)).select("doc_id", "lang", "lang_pred", "lang_p")
