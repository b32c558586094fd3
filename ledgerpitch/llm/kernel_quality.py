"""Quality scores by ridge regression on random Fourier features of document statistics.

Every document becomes one short row of statistics of its whole text. Cosines of fixed random
directions approximate a Gaussian kernel on the standardised rows, so a kernel regression needs only
the normal equations of those features: each task sums them over its labelled rows, the sums are
added up by fold, and the driver solves a system whose size does not depend on the data. Scores of
rows whose fold was left out are calibrated by isotonic regression over counts by score bin.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerpitch.llm.common import arrow_map, durable

#: Random Fourier features, their seed, and the ridge penalty for each labelled row.
FEATURES, SEED, RIDGE = 256, 12, 1e-4
#: Standardised statistics are cut here, and the kernel's width in units of sqrt(statistics).
CLIP, WIDTH = 6.0, 0.5
#: Rows whose crc32 of the id leaves 0 by this are never learnt from; the other remainders are folds.
FOLDS = 5
#: Labelled rows that one task sums.
TASK_ROWS = 200_000
#: Score bins of the calibration, over raw scores from LOWEST to HIGHEST.
BINS, LOWEST, HIGHEST = 4096, -1.0, 2.0
#: Calibrated scores at or above this are predicted as label 1.
THRESHOLD = 0.3
#: Score of every document where no row has a label.
UNKNOWN = 0.5

STATISTICS = (
    "log_chars", "log_words", "log_lines", "mean_word", "distinct", "log_distinct", "distinct_pairs", "top_word", "repeats",
    "upper", "digits", "blanks", "symbols", "marks", "exclamations", "other_bytes", "capitalised", "short_words", "long_words",
    "distinct_lines", "mean_line", "ends",
)

_CLASS = np.zeros(256, np.int64)
for _name, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b"#$%&*|@^~<>{}[]\\_=+/", b".,;:'\"()-?", b"!"), 1):
    _CLASS[list(_bytes)] = _name
_CLASS[128:] = 7
_CLASS[0x80:0xC0] = 8


def text_statistics(text: bytes) -> list[float]:
    """The values of ``STATISTICS`` for a text in UTF-8; all shares lie in 0 to 1."""
    by_class = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(text, np.uint8), minlength=256), minlength=9)
    chars = max(1.0, len(text) - by_class[8])
    words = text.split()
    n = len(words)
    lines = text.split(b"\n")
    if n:
        lowered = text.lower().split()
        counts: dict[bytes, int] = {}
        for word in lowered:
            counts[word] = counts.get(word, 0) + 1
        sizes = np.fromiter(map(len, words), np.int64, n)
        pairs = len(set(zip(lowered, lowered[1:], strict=False)))
        same = sum(map(bytes.__eq__, lowered, lowered[1:]))
        distinct = len(counts) / n
        by_word = [
            sizes.mean() / 20, distinct, np.log1p(len(counts)) / np.log1p(n), pairs / max(1, n - 1), max(counts.values()) / n, same / n,
        ]
        shapes = [sum(map(bytes.istitle, words)) / n, (sizes <= 2).sum() / n, (sizes >= 12).sum() / n]
    else:
        by_word, shapes = [0.0] * 6, [0.0] * 3
    full = [line for line in lines if line.strip()]
    ends = sum(line.rstrip().endswith((b".", b"!", b"?", b":", b'"')) for line in full) / max(1, len(full))
    shares = by_class[[1, 2, 3, 4, 5, 6, 7]] / chars
    return [
        np.log1p(len(text)) / 10, np.log1p(n) / 10, np.log1p(len(lines)) / 10, *by_word, *shares, *shapes,
        len(set(full)) / max(1, len(full)), np.log1p(n / max(1, len(full))) / 5, ends,
    ]


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, fold, stats) of every row; fold is crc32 of the id as text, modulo ``FOLDS``.

    A null text counts as empty, a null id as the empty string.
    """
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)).cast("int")
    rows = docs.select("doc_id", fold.alias("fold"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            yield {"doc_id": batch.column("doc_id"), "fold": batch.column("fold"), "stats": [text_statistics(t) for t in texts]}

    kind = rows.schema["doc_id"].dataType.simpleString()
    return arrow_map(rows, run, f"doc_id {kind}, fold int, stats array<float>")


class FourierFeatures:
    """Cosine features of standardised rows, whose products approximate a Gaussian kernel."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.directions = rng.standard_normal((len(mean), features)) / (WIDTH * np.sqrt(len(mean)))
        self.shifts = rng.uniform(0, 2 * np.pi, features)

    def of(self, rows: np.ndarray) -> np.ndarray:
        standard = np.clip((rows - self.mean) / self.scale, -CLIP, CLIP)
        waves = np.sqrt(2 / len(self.shifts)) * np.cos(standard @ self.directions + self.shifts)
        return np.hstack([waves, np.ones((len(rows), 1))])


def _rows(batch: pa.RecordBatch, columns: int = len(STATISTICS)) -> np.ndarray:
    return batch.column("stats").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, columns)


def _equations(train: DataFrame, features: FourierFeatures, rows: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The normal equations by fold: (features x features, features x label).

    A task sums all its rows; the sums are added in Spark, a row of the matrix at a time.
    """
    size = len(features.shifts) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            waves = features.of(_rows(batch))
            labels = batch.column("label").to_numpy(zero_copy_only=False).astype(np.float64)
            folds = batch.column("fold").to_numpy(zero_copy_only=False)
            for fold in np.unique(folds):
                own = waves[folds == fold]
                both = own.T @ np.hstack([own, labels[folds == fold][:, None]])
                sums[int(fold)] = sums[int(fold)] + both if int(fold) in sums else both
        for fold, both in sums.items():
            yield {"fold": [fold] * size, "at": range(size), "sums": both.tolist()}

    def added(group: pd.DataFrame) -> pd.DataFrame:
        total = np.sum(np.stack(group["sums"].to_numpy()), axis=0)
        return pd.DataFrame({"fold": group["fold"][:1], "at": group["at"][:1], "sums": [total]})

    schema = "fold int, at int, sums array<double>"
    partial = arrow_map(train.coalesce(max(1, -(-rows // TASK_ROWS))), run, schema)
    out: dict[int, np.ndarray] = {}
    for r in partial.groupBy("fold", "at").applyInPandas(added, schema).collect():
        out.setdefault(r["fold"], np.zeros((size, size + 1)))[r["at"]] = r["sums"]
    return {fold: (both[:, :-1], both[:, -1]) for fold, both in out.items()}


def ridge(matrix: np.ndarray, target: np.ndarray, rows: int, penalty: float = RIDGE) -> np.ndarray:
    """Weights of the ridge regression; the last feature, the constant, is not penalised."""
    held = np.full(len(target), penalty * max(1, rows))
    held[-1] = 1e-9
    return np.linalg.solve(matrix + np.diag(held), target)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The closest non-decreasing sequence by weighted squares (pools of adjacent violators)."""
    pools: list[list[float]] = []
    for value, weight in zip(values, weights, strict=True):
        pools.append([float(value), float(weight), 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            value_, weight_, n = pools.pop()
            last = pools[-1]
            last[0] = (last[0] * last[1] + value_ * weight_) / (last[1] + weight_)
            last[1] += weight_
            last[2] += n
    return np.repeat([p[0] for p in pools], [int(p[2]) for p in pools])


def _bins(raw: np.ndarray) -> np.ndarray:
    return np.clip(((raw - LOWEST) / (HIGHEST - LOWEST) * BINS).astype(np.int64), 0, BINS - 1)


class QualityModel:
    """Calibrated scores of statistics."""

    def __init__(self, features: FourierFeatures | None, weights: np.ndarray, knots: np.ndarray, values: np.ndarray):
        self.features, self.weights, self.knots, self.values = features, weights, knots, values

    def score(self, rows: np.ndarray) -> np.ndarray:
        if self.features is None:
            return np.full(len(rows), UNKNOWN)
        raw = self.features.of(rows) @ self.weights
        return np.interp(raw, self.knots, self.values).round(9)


def fit(stats: DataFrame, labels: DataFrame) -> QualityModel:
    """The model learnt from all labelled rows of ``stats`` whose fold is not 0.

    A document's label is the largest of its label rows; null ids and null labels say nothing. The
    driver gets sums: the normal equations by fold and label counts by score bin.
    """
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    train = durable(stats.filter("fold <> 0").join(known, "doc_id").select("fold", "stats", "label"))
    at = [F.element_at("stats", k + 1).cast("double") for k in range(len(STATISTICS))]
    moments = train.agg(F.count("*"), *(f(c) for c in at for f in (F.avg, F.stddev_pop))).first()
    rows = moments[0]
    if not rows:
        return QualityModel(None, np.zeros(0), np.zeros(0), np.zeros(0))
    mean, spread = np.array(moments[1::2], float), np.array(moments[2::2], float)
    features = FourierFeatures(mean, np.where(spread > 1e-6, spread, 1.0))
    sums = _equations(train, features, rows)
    matrix, target = (np.sum([s[k] for s in sums.values()], axis=0) for k in (0, 1))
    # Rows are scored for calibration by weights that never saw their fold.
    if len(sums) > 1:
        without = {f: ridge(matrix - m, target - t, rows - m[-1, -1]) for f, (m, t) in sums.items()}
    else:
        without = {f: ridge(matrix, target, rows) for f in sums}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        counts = np.zeros((BINS, 2), np.int64)
        for batch in batches:
            waves = features.of(_rows(batch))
            folds = batch.column("fold").to_numpy(zero_copy_only=False)
            labels_ = batch.column("label").to_numpy(zero_copy_only=False)
            for fold, weights in without.items():
                own = folds == fold
                np.add.at(counts, (_bins(waves[own] @ weights), np.clip(labels_[own], 0, 1)), 1)
        used = np.flatnonzero(counts.sum(1))
        yield {"bin": used, "zeros": counts[used, 0], "ones": counts[used, 1]}

    binned = (
        arrow_map(train.select("fold", "stats", "label"), run, "bin int, zeros long, ones long")
        .groupBy("bin")
        .agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))
        .orderBy("bin")
        .collect()
    )
    zeros, ones = np.array([[r["zeros"], r["ones"]] for r in binned], float).T
    knots = LOWEST + (np.array([r["bin"] for r in binned]) + 0.5) * (HIGHEST - LOWEST) / BINS
    return QualityModel(features, ridge(matrix, target, rows), knots, isotonic(ones / (zeros + ones), zeros + ones))


def _scored(stats: DataFrame, model: QualityModel) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            scores = model.score(_rows(batch))
            folds = batch.column("fold").to_numpy(zero_copy_only=False)
            yield {"doc_id": batch.column("doc_id"), "held_out": folds == 0, "score": scores, "predicted": (scores >= THRESHOLD).astype(np.int32)}

    kind = stats.schema["doc_id"].dataType.simpleString()
    return arrow_map(stats, run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``.

    The score looks at the whole text only; a null text counts as empty, and empty texts have a
    score too. Rows with equal texts have equal scores. held_out says that crc32 of the id as text
    (null: the empty string) leaves 0 by 5: such rows are never learnt from. Label rows without an
    id or a quality are ignored, of several for an id the largest counts, documents with a repeated
    id all count. Where no row can be learnt from, every score is 0.5. An empty table gives no
    rows. Other columns are ignored.
    """
    stats = durable(statistics(docs))
    return _scored(stats, fit(stats, labels))
