"""Quality classifier: histogram gradient-boosted trees over statistics of a text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nlcorpus.llm.common import WORDS_CHARS, WordCodes, bucket, saved, slices
from nlcorpus.llm.fertility import repeated_lines, repeated_words

MAX_TRAIN_ROWS = 20_000  # labelled rows that fit the trees; chosen by a hash of the id when there are more
FOLDS, HELD_OUT = 5, 0
ACCEPT = 0.3
TREES, LEAVES, BINS, RATE, LEAST_LEAF, RIDGE = 60, 12, 64, 0.15, 20, 1.0

CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789",
           "stop": b".", "comma": b",;:", "loud": b"!?", "symbol": b"#*$%&|<>", "quote": b"\"'()[]{}", "break": b"\n",
           "blank": b" \t\r\x0b\x0c", "other": b"+-_/=@\\^`~"}
FEATURES = ["log_chars", "log_words", "word_length", "distinct_share", "top_share", "repeat_share", "line_repeat_share",
            "words_per_line", "words_per_stop", "title_share", "short_share", "long_share",
            *[f"{name}_share" for name in CLASSES], "high_share"]


def _class_table() -> bytes:
    table = bytearray(len(CLASSES) if i < 128 else len(CLASSES) + 1 for i in range(256))
    for number, members in enumerate(CLASSES.values()):
        for byte in members:
            table[byte] = number
    return bytes(table)


CLASS_TABLE = _class_table()


def statistics(texts: list[str], codes: WordCodes) -> np.ndarray:
    """A row of ``FEATURES`` per text; only the text is looked at. Empty texts have zeros."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    words = [b.split() for b in raw]
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    lowered = codes([w.lower() for one in words for w in one])
    repeats = repeated_words(lowered, bounds)
    sizes = np.fromiter((len(w) for one in words for w in one), dtype=np.int64, count=int(bounds[-1]))
    title = np.fromiter((w[:1].isupper() for one in words for w in one), dtype=bool, count=int(bounds[-1]))
    out = np.zeros((len(texts), len(FEATURES)))
    for row, (text, data) in enumerate(zip(texts, raw)):
        if not data:
            continue
        kinds = data.translate(CLASS_TABLE)
        share = [kinds.count(bytes([k])) / len(data) for k in range(len(CLASSES))]
        a, b = bounds[row], bounds[row + 1]
        n = int(b - a)
        own, top = sizes[a:b], 0
        if n:
            distinct, counts = np.unique(lowered[a:b], return_counts=True)
            top = counts.max()
        lines = data.count(b"\n") + 1
        stops = data.count(b". ") + data.count(b".\n") + 1
        out[row] = [np.log1p(len(text)), np.log1p(n), own.mean() if n else 0, len(distinct) / n if n else 0,
                    top / max(n, 1), repeats[row] / max(n, 1), repeated_lines(text) / lines, n / lines, n / stops,
                    title[a:b].mean() if n else 0, (own <= 2).mean() if n else 0, (own >= 16).mean() if n else 0,
                    *share, kinds.count(bytes([len(CLASSES) + 1])) / len(data)]
    return out


def features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, x array<double>)`` of every whole text, in one pass without a shuffle; a null text is an empty one."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for batch in slices(batches, size=WORDS_CHARS):
            x = statistics([t or "" for t in batch.column(1).to_pylist()], codes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["k", "x"])

    frame = docs.select(docs[key].alias("k"), docs[text].alias("t"))
    kind = frame.schema["k"].dataType.simpleString()
    return frame.mapInArrow(run, f"k {kind}, x array<double>").withColumnRenamed("k", key)


@dataclass
class Trees:
    """All trees in flat arrays; a leaf points at itself, so a fixed number of steps ends in a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for every row; all rows walk down one tree at a time."""
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                below = x[rows, self.feature[node]] <= self.threshold[node]
                node = np.where(below, self.left[node], self.right[node])
            total += self.value[node]
        return 1.0 / (1.0 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees on the logistic loss; splits are searched on histograms of at most ``BINS`` bins.

    Deterministic: ties go to the first feature and bin. Without rows of both labels the score is a constant.
    """
    rate = (y.sum() + 1.0) / (len(y) + 2.0)
    start = float(np.log(rate / (1 - rate)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.empty(0)
            for f in range(len(FEATURES))]
    bins = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1) if len(x) \
        else np.empty((0, len(FEATURES)), int)
    offsets = np.arange(len(FEATURES)) * BINS
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots, deepest, margin = [], 1, np.full(len(y), start)

    def histogram(rows, gradient, hessian):
        slots = (bins[rows] + offsets).ravel()
        total = [np.bincount(slots, np.repeat(v[rows], len(FEATURES)), BINS * len(FEATURES)) for v in (gradient, hessian)]
        return [*total, np.bincount(slots, minlength=BINS * len(FEATURES))]

    def best_split(rows, gradient, hessian):
        g, h, n = (np.cumsum(v.reshape(len(FEATURES), BINS), axis=1) for v in histogram(rows, gradient, hessian))
        G, H, N = g[:, -1:], h[:, -1:], n[:, -1:]
        gain = g ** 2 / (h + RIDGE) + (G - g) ** 2 / (H - h + RIDGE) - G ** 2 / (H + RIDGE)
        gain[(n < LEAST_LEAF) | (N - n < LEAST_LEAF)] = -np.inf
        place = int(np.argmax(gain))
        return float(gain.flat[place]), place // BINS, place % BINS

    def leaf(rows, gradient, hessian):
        nodes.append([0, np.inf, len(nodes), len(nodes), -RATE * gradient[rows].sum() / (hessian[rows].sum() + RIDGE)])
        return len(nodes) - 1

    for _ in range(TREES if len(y) and 0 < y.sum() < len(y) else 0):
        p = 1.0 / (1.0 + np.exp(-margin))
        gradient, hessian = p - y, p * (1 - p)
        everything = np.arange(len(y))
        root = leaf(everything, gradient, hessian)
        roots.append(root)
        open_leaves = {root: (everything, 0, best_split(everything, gradient, hessian))}
        for _ in range(LEAVES - 1):
            node = max(open_leaves, key=lambda k: open_leaves[k][2][0])
            rows, depth, (gain, feature, place) = open_leaves[node]
            if gain <= 1e-6:
                break
            del open_leaves[node]
            below = bins[rows, feature] <= place
            for part in (rows[below], rows[~below]):
                child = leaf(part, gradient, hessian)
                open_leaves[child] = (part, depth + 1, best_split(part, gradient, hessian))
            nodes[node] = [feature, cuts[feature][place], len(nodes) - 2, len(nodes) - 1, 0.0]
            deepest = max(deepest, depth + 1)
        for node, (rows, _, _) in open_leaves.items():
            margin[rows] += nodes[node][4]
    table = np.array(nodes, dtype=float).reshape(-1, 5)
    return Trees(table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4],
                 np.array(roots, dtype=int), deepest, start)


def train(measured: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality",
          max_rows: int = MAX_TRAIN_ROWS) -> Trees:
    """Trees from labelled rows outside the held-out fold.

    At most ``max_rows`` rows reach the driver, those with the least hash of the id. Null labels are left out.
    """
    marked = labels.select(F.col(key), F.col(label).cast("double").alias("__y")).where(
        F.col("__y").isNotNull() & (bucket(F.col(key), FOLDS) != HELD_OUT))
    rows = (measured.join(marked, key).orderBy(F.xxhash64(key), key, "__y").limit(max_rows)
            .select("x", "__y").toArrow())
    x = np.array(rows.column("x").to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    return fit(x, rows.column("__y").to_numpy())


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
          label: str = "quality") -> DataFrame:
    """``(key, held_out, score, predicted)`` for every document; repeated rows score alike, empty texts too."""
    measured = saved(features(docs, key, text), "statistics")
    trees = train(measured, labels, key, label)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(trees.scores(flat.reshape(-1, len(FEATURES))))],
                                             ["k", "score"])

    kind = measured.schema[key].dataType.simpleString()
    scored = measured.mapInArrow(run, f"k {kind}, score double").withColumnRenamed("k", key)
    return scored.select(key, (bucket(F.col(key), FOLDS) == HELD_OUT).alias("held_out"), "score",
                         (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
             label: str = "quality") -> DataFrame:
    """The rows of ``docs`` that score ``ACCEPT`` or more, all columns as they are; without a shuffle of texts."""
    trees = train(saved(features(docs, key, text), "statistics"), labels, key, label)
    place = docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for batch in slices(batches, place, WORDS_CHARS):
            x = statistics([t or "" for t in batch.column(place).to_pylist()], codes)
            yield batch.filter(pa.array(trees.scores(x) >= ACCEPT))

    return docs.mapInArrow(run, docs.schema)
