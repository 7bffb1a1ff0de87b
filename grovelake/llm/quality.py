"""Operator 3, quality rules: hashed word and character n-gram logistic regression.

Word 1- and 2-grams and character 4-grams are hashed into one weight table each; a text's logit is the mean
weight of each kind of gram (drawn to 0 where there are few) plus a bias, so that texts of every length are on one scale. The model is fitted
by Adam on a bounded sample of labelled rows (``max_labelled``), then calibrated by Platt's method on a part
that it was not fitted on, a fifth of each class; a class of one row is fitted on only and leaves the model
uncalibrated. Whole texts are scored in Arrow batches; fixed thresholds give the decision.

Defined results: a null or blank text has no evidence, its probability is null and its decision ``reject``;
where there are no labelled rows of both classes, every probability is null and every decision of a text with
words is ``keep``. Repeated rows each get their own result. Labels of a document that disagree count each, at most
``max_labelled`` rows in all however often ids repeat. Columns ``quality_p`` and ``quality_decision`` of the input
are replaced by ``score_quality``; the pipeline's stage hands on all columns as they came.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbuf as tb

BITS = 18
KEEP, REJECT = 0.5, 0.2
MAX_LABELLED = 4000
PRIOR = 12  #: so many grams of weight 0 are added to each mean: a few grams are little evidence
SAME = np.uint64(0x51ED27)  #: the gram of a word that follows itself


@dataclass
class QualityModel:
    words: np.ndarray
    chars: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0


def _grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Indices of word grams, with lo and hi of each text; the same of character grams."""
    starts, ends, first = tb.words(data, offs)
    h = tb.word_hashes(data, starts, ends)
    pair = tb.mix(np.where(h[:-1] == h[1:], SAME, h[:-1] * np.uint64(31) + h[1:])) if len(h) > 1 else h[:0]
    inner = first[1:-1]
    index = np.empty(2 * len(h), np.int64)
    index[0::2] = (h >> np.uint64(64 - BITS)).astype(np.int64)
    index[1::2] = index[0::2]
    if len(pair):
        index[1:-1:2] = (pair >> np.uint64(64 - BITS)).astype(np.int64)
        over = inner[(inner > 0) & (inner < len(h))] - 1  # a pair across two texts counts as its first word
        index[2 * over + 1] = index[2 * over]
    begin = np.flatnonzero((data & 0xC0) != 0x80)  # characters
    edge = np.append(begin, len(data))
    grams = tb.word_hashes(data, edge[:-4], edge[4:], folded=False)
    own = np.searchsorted(begin, offs)
    return index, 2 * first[:-1], 2 * first[1:], (grams >> np.uint64(64 - BITS)).astype(np.int64), own[:-1], np.maximum(own[1:] - 3, own[:-1])


def _logits(model: QualityModel, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Uncalibrated logits, and the number of word grams of each text."""
    w, wlo, whi, c, clo, chi = _grams(data, offs)
    words = tb.segment_sums(model.words[w], wlo, whi) / (np.maximum(whi - wlo, 0) + PRIOR)
    chars = tb.segment_sums(model.chars[c], clo, chi) / (np.maximum(chi - clo, 0) + PRIOR)
    return words + chars + model.bias, whi - wlo


def score_texts(model: QualityModel, texts: pa.Array) -> pa.Array:
    """The calibrated probability of good quality; null for a text without words."""
    out = np.full(len(texts), np.nan)
    for row, data, offs in tb.slices(texts):
        z, n = _logits(model, data, offs)
        out[row : row + len(n)] = np.where(n > 0, 1 / (1 + np.exp(-np.clip(model.slope * z + model.shift, -50, 50))), np.nan)
    return pa.array(out, pa.float64(), mask=np.isnan(out))


def fit(texts: list[str], labels: list[int], epochs: int = 6, batch: int = 128, seed: int = 5) -> QualityModel | None:
    """Fitted on four fifths of the rows, calibrated on the rest; None without rows of both classes."""
    y = np.asarray(labels, float)
    if len(set(labels)) < 2:
        return None
    size = 1 << BITS
    weights = [np.zeros(size, np.float32), np.zeros(size, np.float32)]
    moment = [np.zeros(size, np.float32) for _ in range(2)]
    second = [np.zeros(size, np.float32) for _ in range(2)]
    order = np.random.default_rng(seed).permutation(len(y))
    classes = [order[y[order] == k] for k in (0, 1)]
    n_held = [max(1, len(c) // 5) if len(c) > 1 else 0 for c in classes]
    held, used = (np.concatenate([c[part(n)] for c, n in zip(classes, n_held)]) for part in (lambda n: slice(0, n), lambda n: slice(n, None)))
    bias, step = 0.0, 0
    rng = np.random.default_rng(seed + 1)
    for _ in range(epochs):
        rng.shuffle(used)
        for at in range(0, len(used), batch):
            rows = used[at : at + batch]
            step += 1
            parts = [[], []]
            z = np.zeros(len(rows))
            for row, data, offs in tb.slices(pa.array([texts[k] for k in rows], pa.large_string())):
                w, wlo, whi, c, clo, chi = _grams(data, offs)
                for kind, (index, lo, hi) in enumerate(((w, wlo, whi), (c, clo, chi))):
                    n = np.maximum(hi - lo, 0)
                    z[row : row + len(n)] += tb.segment_sums(weights[kind][index], lo, hi) / (n + PRIOR)
                    flat = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    parts[kind].append((index[flat], np.repeat(np.arange(row, row + len(n)), n), np.repeat(1 / (n + PRIOR), n)))
            g = (1 / (1 + np.exp(-(z + bias))) - y[rows]) / len(rows)
            bias -= 0.5 * g.sum()
            for kind in range(2):
                index, owner, share = (np.concatenate(x) for x in zip(*parts[kind]))
                grad = np.bincount(index, g[owner] * share, size).astype(np.float32) + 1e-7 * weights[kind]
                moment[kind] += 0.1 * (grad - moment[kind])
                second[kind] += 0.01 * (grad * grad - second[kind])
                weights[kind] -= 0.3 * (moment[kind] / (1 - 0.9**step)) / (np.sqrt(second[kind] / (1 - 0.99**step)) + 1e-6)
    model = QualityModel(weights[0], weights[1], bias)
    if len(set(y[held])) == 2:
        z = np.concatenate([_logits(model, d, o)[0] for _, d, o in tb.slices(pa.array([texts[k] for k in held], pa.large_string()))])
        model.slope, model.shift = _platt(z, y[held])
    return model


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method, with Platt's smoothed targets."""
    good, bad = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    scale = max(float(np.std(z)), 1e-9)
    x = np.stack([z / scale, np.ones_like(z)], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        move = np.linalg.solve(hess, x.T @ (p - target) + 1e-4 * (beta - [1.0, 0.0]))
        beta -= np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return float(max(beta[0], 1e-6) / scale), float(beta[1])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", max_labelled: int = MAX_LABELLED) -> QualityModel | None:
    """Fits on at most ``max_labelled`` labelled rows, those of the smallest hashed keys."""
    chosen = (
        labels.select(F.col(id_col).alias("k"), F.col("quality").cast("int").alias("y"))
        .where("k IS NOT NULL AND y IN (0, 1)")
        .orderBy(F.xxhash64("k"), "k", "y")
        .limit(max_labelled)
    )
    texts = docs.select(F.col(id_col).alias("k"), F.col(text).alias("t")).where("k IS NOT NULL AND t IS NOT NULL")
    found = texts.join(F.broadcast(chosen), "k")  # at most max_labelled short rows
    rows = found.orderBy(F.xxhash64("k"), "k", "y", F.xxhash64("t")).limit(max_labelled).toArrow()
    return fit(rows["t"].to_pylist(), rows["y"].to_pylist())


def quality_score(model: QualityModel, text: Column, spark) -> Column:
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return score_texts(shared.value, texts)

    return score(text)


def _scored(docs: DataFrame, model: QualityModel | None, text: str, keep: float, reject: float) -> DataFrame:
    """(row, p, decision): the columns of ``docs``, whatever their names, and what is said of each row."""
    blank = F.col(text).isNull() | ~F.col(text).rlike(tb.SOLID.pattern)
    p = F.lit(None).cast("double") if model is None else quality_score(model, F.col(text), docs.sparkSession)
    out = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), blank.alias("blank"), p.alias("p"))
    decision = F.when(F.col("blank"), "reject").when(F.col("p").isNull() | (F.col("p") >= keep), "keep").when(F.col("p") >= reject, "review").otherwise("reject")
    return out.select("row", "p", decision.alias("decision"))


def score_quality(docs: DataFrame, model: QualityModel | None, text: str = "text", keep: float = KEEP, reject: float = REJECT) -> DataFrame:
    """``docs`` with ``quality_p`` and ``quality_decision`` (keep, review, reject) after its own columns."""
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("quality_p", "quality_decision")]
    return _scored(docs, model, text, keep, reject).select(*kept, F.col("p").alias("quality_p"), F.col("decision").alias("quality_decision"))


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model).select("doc_id", "quality_p", "quality_decision")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; those kept or for review stay."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _scored(docs, model, "text", KEEP, REJECT).where("decision <> 'reject'").select("row.*")
