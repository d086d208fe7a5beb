"""Quality classifier: regularised quadratic discriminant on transformed document statistics.

Statistics of a whole text (lengths, shares of byte classes, repetition, entropy) are brought near to normal by logs and
log-odds. The two classes get means and covariances from sums over all labelled rows (added up by Spark, d x d numbers reach
the driver). Covariances are shrunk towards the pooled one and its diagonal. A score is the logistic of the difference of
the two log densities plus the log odds of the classes; Mahalanobis distances use the inverse Cholesky factors, cached in the model.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.text import runs, small_batches, text_of, utf8
from holdfast.session import cut

FEATURES = ("log_bytes", "log_words", "log_word_len", "letters", "upper", "digits", "stops", "bangs", "quotes", "symbols", "spaces", "newlines", "wide", "distinct_words", "distinct_lines", "long_words", "entropy", "most_common")
_CLASSES = {"letters": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "stops": b".,;:", "bangs": b"!?", "quotes": b"'\"()-", "symbols": b"#$%&*+/<=>@[\\]^_`{|}~", "spaces": b" \t\x0b\x0c\r", "newlines": b"\n", "wide": bytes(range(128, 256))}
_SPACE = b" \t\n\x0b\x0c\r"


def log_odds(share: np.ndarray, eps: float = 2e-3) -> np.ndarray:
    return np.log((share + eps) / (1.0 - share + eps))


def statistics(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One line of transformed statistics for each text; an empty text has zero lengths and shares."""
    n = len(off) - 1
    size = np.diff(off).astype(float)
    out = np.zeros((n, len(FEATURES)))
    row = np.repeat(np.arange(n), np.diff(off))
    hist = np.bincount(row * 256 + raw, minlength=n * 256).reshape(n, 256).astype(float)
    some = np.maximum(size, 1.0)
    texts = raw.tobytes()
    words, kinds, lines, line_kinds, longs, most = (np.zeros(n) for _ in range(6))
    for k in range(n):
        text = texts[off[k]:off[k + 1]]
        w = text.split()
        words[k] = len(w)
        kinds[k] = len(set(w))
        longs[k] = max(map(len, w), default=0)
        rows = text.split(b"\n")
        lines[k], line_kinds[k] = len(rows), len(set(rows))
    p = hist / some[:, None]
    most = np.delete(p, list(_SPACE), axis=1).max(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = -np.where(p > 0, p * np.log2(np.where(p > 0, p, 1.0)), 0.0).sum(axis=1)
    got = {name: log_odds(hist[:, list(chars)].sum(axis=1) / some) for name, chars in _CLASSES.items()}
    got |= {"log_bytes": np.log1p(size), "log_words": np.log1p(words), "log_word_len": np.log1p(size / np.maximum(words, 1.0)), "distinct_words": log_odds(kinds / np.maximum(words, 1.0), 0.05),
            "distinct_lines": log_odds(line_kinds / np.maximum(lines, 1.0), 0.05), "long_words": np.log1p(longs), "entropy": entropy, "most_common": log_odds(most)}
    for i, name in enumerate(FEATURES):
        out[:, i] = got[name]
    return out


@dataclass
class Model:
    """Means, inverse Cholesky factors and log determinants of both classes; the log odds of class 1."""
    mean: np.ndarray
    inverse: np.ndarray
    log_det: np.ndarray
    log_prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        d = [((x - self.mean[c]) @ self.inverse[c].T) for c in (0, 1)]
        diff = 0.5 * ((d[0] ** 2).sum(axis=1) - (d[1] ** 2).sum(axis=1)) + 0.5 * (self.log_det[0] - self.log_det[1]) + self.log_prior
        return 1.0 / (1.0 + np.exp(-np.clip(diff, -700, 700)))


def fit(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float = 0.1, diagonal: float = 0.1, floor: float = 1e-3) -> Model:
    """From (rows, sum, sum of outer products) by class. A class without rows takes the other's shape; without any rows all score 1/2."""
    d = len(FEATURES)
    none = (0.0, np.zeros(d), np.zeros((d, d)))
    got = [moments.get(c, none) for c in (0, 1)]
    total = sum(n for n, _, _ in got)
    if not total:
        return Model(np.zeros((2, d)), np.stack([np.eye(d)] * 2), np.zeros(2), 0.0)
    every = sum(s for _, s, _ in got) / total
    mean = np.stack([s / n if n else every for n, s, _ in got])
    scatter = [o - n * np.outer(m, m) if n else np.zeros((d, d)) for (n, _, o), m in zip(got, mean)]
    pooled = sum(scatter) / total
    pooled = (1 - diagonal) * pooled + diagonal * np.diag(np.diag(pooled)) + floor * np.eye(d)
    inverse, log_det = [], []
    for (n, _, _), s in zip(got, scatter):
        own = (s + d * pooled) / (n + d)  # as if d further rows had the pooled shape
        low = np.linalg.cholesky((1 - shrink) * own + shrink * pooled)
        inverse.append(np.linalg.inv(low))
        log_det.append(2 * np.log(np.diag(low)).sum())
    return Model(mean, np.stack(inverse), np.array(log_det), float(np.log((got[1][0] + 1) / (got[0][0] + 1))))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, x: the statistics of every row's whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = utf8(b["text"])
            for i, j in runs(off, 1 << 21):
                x = statistics(raw[off[i]:off[j]], off[i:j + 1] - off[i])
                yield pa.RecordBatch.from_arrays([b["doc_id"][i:j], pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "x"])
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.select('doc_id').dtypes[0][1]}, x array<double>")


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Class sums of (x, quality): added up within tasks, then by Spark; a few lines reach the driver."""
    d = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros((2, 1 + d + d * d))
        for b in batches:
            if not b.num_rows:
                continue
            x = b["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            y = b["quality"].to_numpy(zero_copy_only=False)
            for c in (0, 1):
                z = x[y == c]
                acc[c] += np.concatenate([[len(z)], z.sum(axis=0), (z.T @ z).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], acc.shape[1]), pa.int32()), pa.array(np.tile(np.arange(acc.shape[1]), 2), pa.int32()), pa.array(acc.ravel(), pa.float64())], ["class", "i", "v"])
    sums = rows.select("x", "quality").mapInArrow(run, "class int, i int, v double").groupBy("class", "i").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros((2, 1 + d + d * d))
    for r in sums:
        flat[r["class"], r["i"]] = r["v"]
    return {c: (f[0], f[1:1 + d], f[1 + d:].reshape(d, d)) for c, f in enumerate(flat) if f[0] > 0}


def train(x: DataFrame, labels: DataFrame, **options: float) -> Model:
    """Fit on the rows of ``x`` with a label 0 or 1, held-out ones left out. Labels of one doc_id that disagree are skipped."""
    y = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.max("quality").cast("int").alias("top")).where("quality = top").drop("top")
    return fit(moments(x.where(~held_out()).join(y, "doc_id")), **options)


def scored(x: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    d = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(b["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, d)) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], ["doc_id", "score", "predicted"])
    return x.select("doc_id", "x").mapInArrow(run, f"doc_id {x.select('doc_id').dtypes[0][1]}, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; texts are read once, their statistics are stored.

    Null and empty texts are scored like others (all lengths and shares 0); a null doc_id is scored but never learnt from;
    repeated rows are scored each; null or other labels are ignored, without labels every score is 1/2; an empty
    table gives an empty result. Only the text enters a score.
    """
    x = cut(features(docs), "quality-features")
    return scored(x, train(x, labels), threshold).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns; rejected rows go.

    Texts are read twice where they lie, once for the statistics that the model is fitted on and once to be scored. Only
    (doc_id, statistics) are shuffled, to meet their labels.
    """
    small_batches(docs.sparkSession)
    model = train(cut(features(docs), "quality-features"), labels)

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd
        raw, off = utf8(pa.array(texts, pa.string()))
        parts = [model.score(statistics(raw[off[i]:off[j]], off[i:j + 1] - off[i])) for i, j in runs(off, 1 << 21)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))
    return docs.where(score(text_of()) >= threshold)
