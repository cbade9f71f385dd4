"""Quality scores learned from preference pairs (Bradley-Terry): P(a before b) = sigmoid(w . (x_a - x_b)).

Features describe the text alone. The fit uses at most `most` labelled training rows (those with the smallest hash of doc_id)
and `pairs` sampled pairs; scoring and features cover every whole text. The scores are centred at the quantile that equals
the share of rejected training rows, so 0.5 is the threshold. Null and empty texts have features of zero and a score like
any other. With labels of one kind only, every score is 0.5."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import small_batches
from .textbatch import as_bytes

NAMES = ("length", "upper", "letters", "digits", "marks", "shouts", "bars", "lines", "word_length", "long_words", "distinct", "top_word", "repeats", "same_lines", "deflate", "stops", "commas")
_COUNT = np.zeros((256, 6))
_COUNT[list(range(65, 91)), 0] = 1
_COUNT[[*range(65, 91), *range(97, 123), *range(128, 256)], 1] = 1
_COUNT[list(range(48, 58)), 2] = 1
_COUNT[[ord(c) for c in "#$%&*@^~=<>{}[]\\_+/"], 3] = 1
_COUNT[ord("!"), 4] = 1
_COUNT[ord("|"), 5] = 1


def features(text: str | None) -> list[float]:
    raw = as_bytes(text)
    if not raw:
        return [0.0] * len(NAMES)
    n = len(raw)
    upper, letters, digits, marks, shouts, bars = (np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _COUNT).tolist()
    words = raw.split()
    m = max(1, len(words))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        np.log1p(m) / 10, upper / max(1, letters), letters / n, digits / n, min(1, 4 * marks / m), min(1, 2 * shouts / m), min(1, 2 * bars / m),
        min(1, 10 * raw.count(b"\n") / m), min(1, n / m / 20), sum(len(w) > 20 for w in counts) / max(1, len(counts)), len(counts) / m, max(counts.values(), default=0) / m,
        sum(map(bytes.__eq__, words, words[1:])) / m, 1 - len(set(lines)) / max(1, len(lines)), min(1, len(zlib.compress(raw, 1)) / n), (raw.count(b". ") + raw.count(b".\n")) / m, raw.count(b",") / m,
    ]


def feature_column(text: str):
    return F.pandas_udf(lambda s: s.map(features), "array<double>")(text)


def fit_bradley_terry(x: np.ndarray, y: np.ndarray, pairs: int = 60_000, ridge: float = 1e-4, steps: int = 25) -> dict:
    """Weights, centre and scale from features and labels (1 is preferred to 0)."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    mean, sd = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(len(NAMES)), np.ones(len(NAMES)))
    w = np.zeros(len(NAMES))
    if not len(good) or not len(bad):
        return {"w": w, "mean": mean, "sd": sd, "centre": 0.0}
    z, draw = np.clip((x - mean) / sd, -6, 6), np.random.default_rng(7)
    d = z[draw.choice(good, pairs)] - z[draw.choice(bad, pairs)]
    for _ in range(steps):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w)), d.T @ (1 - p) / pairs - ridge * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    s = np.sort(z @ w)
    k = len(bad)  # the quantile at the share of rejected rows: half-way between its neighbours
    return {"w": w, "mean": mean, "sd": sd, "centre": float((s[k - 1] + s[min(k, len(s) - 1)]) / 2)}


def held_out(doc_id="doc_id"):
    """Rows that labels aren't learned from; one without doc_id is not held out, and has no labels."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, most: int = 12_000, pairs: int = 60_000) -> dict:
    """Fit on at most `most` labelled rows outside the held-out third."""
    small_batches(documents.sparkSession)
    rows = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # at most `most` rows are broadcast
    found = documents.select("doc_id", "text").join(F.broadcast(rows), "doc_id").select("doc_id", "quality", feature_column("text").alias("x")).orderBy("doc_id").limit(most).collect()
    return fit_bradley_terry(np.array([r["x"] for r in found]).reshape(-1, len(NAMES)), np.array([r["quality"] for r in found]), pairs)


def score(documents: DataFrame, model: dict, name: str = "score") -> DataFrame:
    """All columns of documents and the score (0 to 1; 0.5 and above is kept) under `name`, which replaces a column of that name."""
    small_batches(documents.sparkSession)

    @F.pandas_udf("double")
    def value(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in texts:
            x = np.array([features(t) for t in text]).reshape(-1, len(NAMES))
            s = np.clip((x - model["mean"]) / model["sd"], -6, 6) @ model["w"] - model["centre"]
            yield pd.Series(1 / (1 + np.exp(-np.clip(s, -30, 30))))

    return documents.withColumn(name, value("text"))
