"""Quality classifier: histogram gradient-boosted trees over statistics of whole texts.

Statistics come from counts of byte classes, word hashes and line hashes of each text, in numpy. Trees are grown level
by level on binned statistics with first and second derivatives of the logistic loss, and are flattened into
arrays (feature, threshold and leaf value by tree and heap position), so scoring is one vectorised walk for all rows and
all trees together.

Trees are fitted on the driver on at most `bound` labelled texts (a bounded sample, the only bounded part; all texts are
scored whole). The sample has about as many texts of each label, so each counts for as many labels as it stands for, and the
score keeps to the ratio of all labels whatever the bound is. Labels, language, source and id are never inputs.

Defined results: null counts as an empty text; several labels of one id count by their mean (0.5 and more is 1);
without labels to learn from every score is 0.5, and with one class only it is near that class; a repeated row gets its score each
time, and of several texts of one id one is learnt from; other columns play no part, and a carried column may not have a result's name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out
from .sampling import sample_ids
from .textkernel import SPACE_SEPARATORS, Chunk, chunks, ngram_hashes, words

#: Labelled texts to learn from, at most.
BOUND = 20_000
TREES, DEPTH, BINS, RATE = 80, 4, 64, 0.15

_CLASSES = ("lower", "upper", "digit", "space", "line", "high", "stop", "comma", "bang", "pipe", "mark", "other")
_CLASS_OF = np.full(256, _CLASSES.index("other"), np.uint8)
for _name, _bytes in (
    ("lower", range(97, 123)),
    ("upper", range(65, 91)),
    ("digit", range(48, 58)),
    ("space", (32, 9, 11, 12, 13)),
    ("line", (10,)),
    ("high", range(128, 256)),
    ("stop", b".?"),
    ("comma", b",;:"),
    ("bang", b"!"),
    ("pipe", b"|"),
    ("mark", b"*#$%&<>{}[]=\\/^~_@"),
):
    _CLASS_OF[list(_bytes)] = _CLASSES.index(_name)
_LINE = np.zeros(256, bool)
_LINE[10] = True

FEATURES = (
    *(f"share_{c}" for c in _CLASSES),
    "log_bytes",
    "log_words",
    "mean_word",
    "spread_word",
    "longest_word",
    "short_words",
    "distinct_words",
    "distinct_trigrams",
    "log_lines",
    "distinct_lines",
    "words_a_line",
    "upper_of_letters",
    "words_a_stop",
    "repeated_next_word",
)


def _distinct(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])) if len(h) else np.zeros(0, bool)
    return np.bincount(row[new], minlength=n)


def statistics(chunk: Chunk) -> np.ndarray:
    """One row of FEATURES for each text of a chunk."""
    n, c = len(chunk.begin), len(_CLASSES)
    size = chunk.end - chunk.begin
    row = np.repeat(np.arange(n), size)
    counts = np.bincount(row * c + _CLASS_OF[chunk.data], minlength=n * c).reshape(n, c)
    w = words(chunk, SPACE_SEPARATORS)
    n_words, length = np.diff(w.first), (w.stop - w.start).astype(float)
    some = np.maximum(n_words, 1)
    mean = np.bincount(w.row, length, n) / some
    square = np.bincount(w.row, length**2, n) / some
    longest = np.zeros(n)
    np.maximum.at(longest, w.row, length)
    tri, tri_row = ngram_hashes(w, 3)
    lines = words(chunk, _LINE)
    n_lines = np.diff(lines.first)
    again = np.bincount(w.row[1:][(w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])], minlength=n)
    letters = counts[:, 0] + counts[:, 1] + counts[:, _CLASSES.index("high")]
    share = counts / np.maximum(size, 1)[:, None]
    return np.column_stack(
        [
            share,
            np.log1p(size),
            np.log1p(n_words),
            mean,
            np.sqrt(np.maximum(square - mean**2, 0)),
            np.log1p(longest),
            np.bincount(w.row, length <= 2, n) / some,
            _distinct(w.hash, w.row, n) / some,
            _distinct(tri, tri_row, n) / np.maximum(np.bincount(tri_row, minlength=n), 1),
            np.log1p(n_lines),
            _distinct(lines.hash, lines.row, n) / np.maximum(n_lines, 1),
            n_words / np.maximum(n_lines, 1),
            counts[:, 1] / np.maximum(letters, 1),
            n_words / np.maximum(counts[:, _CLASSES.index("stop")], 1),
            again / some,
        ]
    )


@dataclass
class Forest:
    """Flattened trees: inner node i of a tree has children 2i+1 and 2i+2; go right if value > threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros((len(x), len(self.feature)), np.int64)
        tree, rows = np.arange(len(self.feature)), np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            right = x[rows, self.feature[tree, at]] > self.threshold[tree, at]
            at = 2 * at + 1 + right
        total = self.start + self.leaf[tree, at - (2**DEPTH - 1)].sum(1)
        return 1 / (1 + np.exp(-total))


def fit_forest(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Forest:
    """Trees for the labels y of the rows x; weights count relative to their mean, so that equal ones change nothing."""
    weight = np.ones(len(y)) if weight is None else weight / weight.mean()
    inner, n_features = 2**DEPTH - 1, x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(n_features)]
    binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    base = ((weight * y).sum() + 1) / (len(y) + 2)
    start = float(np.log(base / (1 - base)))
    total = np.full(len(y), start)
    feature, threshold, leaf = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, 2**DEPTH))
    for t in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, n_nodes = 2**level - 1, 2**level
            local = at - first
            best_gain, best_feature, best_bin = np.full(n_nodes, 1e-6), np.zeros(n_nodes, int), np.full(n_nodes, -1)
            for j in range(n_features):
                key = local * BINS + binned[:, j]
                gs = np.bincount(key, g, n_nodes * BINS).reshape(n_nodes, BINS).cumsum(1)
                hs = np.bincount(key, h, n_nodes * BINS).reshape(n_nodes, BINS).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[(hs < 1) | (ht - hs < 1)] = -1
                gain[:, len(edges[j]) :] = -1
                k = gain.argmax(1)
                top = gain[np.arange(n_nodes), k]
                better = top > best_gain
                best_gain[better], best_feature[better], best_bin[better] = top[better], j, k[better]
            split = best_bin >= 0
            feature[t, first : first + n_nodes] = best_feature
            threshold[t, first : first + n_nodes] = [edges[f][b] if s else np.inf for f, b, s in zip(best_feature, best_bin, split, strict=True)]
            right = split[local] & (binned[np.arange(len(y)), best_feature[local]] > best_bin[local])
            at = 2 * at + 1 + right
        local = at - inner
        value = -RATE * np.bincount(local, g, 2**DEPTH) / (np.bincount(local, h, 2**DEPTH) + 1)
        leaf[t] = value
        total = total + value[local]
    return Forest(feature, threshold, leaf, start)


def _statistics_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [statistics(chunk) for chunk in chunks(batch.column(3))]
        if parts:
            x = np.concatenate(parts)
            stats = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], stats], names=["doc_id", "quality", "weight", "stats"])


def train_quality(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> Forest | None:
    """Trees trained on documents with a label (doc_id, quality) that are not held out; None if there are none."""
    usable = labels.where(~held_out("doc_id") & F.col("quality").isNotNull())
    one = usable.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    ids = sample_ids(one, "quality", bound, weight="weight").withColumnRenamed("doc_id", "picked")
    kind = docs.schema["doc_id"].dataType.simpleString()
    picked = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("picked"))  # about `bound` ids
    # one text for an id, however often it is there
    picked = picked.groupBy("doc_id", "quality", "weight").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = picked.mapInArrow(_statistics_rows, f"doc_id {kind}, quality int, weight double, stats array<double>").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.doc_id, r.quality, r.stats))
    return fit_forest(np.array([r.stats for r in rows]), np.array([float(r.quality) for r in rows]), np.array([r.weight for r in rows]))


def _score(batches: Iterator[pa.RecordBatch], forest: Forest | None, text_at: int, keep: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = [np.full(chunk.hi - chunk.lo, 0.5) if forest is None else forest.score(statistics(chunk)) for chunk in chunks(batch.column(text_at))]
        if scores:
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(np.concatenate(scores))], names=[*keep, "score"])


def score_quality(docs: DataFrame, forest: Forest | None, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` (default doc_id) with score, and predicted (1 if the score is 0.5 or more)."""
    carry = list(carry or ["doc_id"])
    if clash := {"score", "predicted"} & set(carry):
        raise ValueError(f"carried columns {sorted(clash)} have the names of results")
    own = docs.select(*carry, F.col(text).alias("_text"))
    schema = T.StructType([own.schema[c] for c in carry] + [T.StructField("score", T.DoubleType())])
    scored = own.mapInArrow(lambda it: _score(it, forest, len(carry), carry), schema)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    forest = train_quality(docs.select("doc_id", "text"), labels.select("doc_id", "quality"))
    return score_quality(docs, forest).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
