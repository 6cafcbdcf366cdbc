"""Language identification by a byte convolutional network, trained and applied in numpy.

A text is cut into windows of fixed length that cover all its bytes. Bytes are embedded, filters of several widths
slide over them, each filter keeps its largest response, and a softmax gives the languages' probabilities;
a text's are the mean over its windows, weighted by their bytes. Windows go through the network in
batches, so memory does not depend on the text's length.

The network is trained on the driver on about `bound` windows of labelled texts, as many of each language and at least one text
of every language (a bounded sample, the only bounded part; all texts are classified whole).

Defined results: null texts and texts without a letter are `und` with score 0, and so is everything when there is nothing
to learn from; a repeated row gets its result each time, and an id is learnt from once for each language that it is given; other columns
play no part, and a carried column may not have a result's name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out
from .sampling import sample_ids
from .textkernel import ASCII_LOWER, Chunk, chunks, mix

WINDOW = 256
#: Windows to train on, and windows from one text, at most.
BOUND, PER_TEXT = 8192, 4
WIDTHS, FILTERS, DIMENSIONS = (2, 3, 4), 8, 6
_BATCH = 512
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def cut(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows padded with 0, row of each, bytes in each) that cover data[begin:end] of every row."""
    per = -(-(end - begin) // WINDOW)
    row = np.repeat(np.arange(len(begin)), per)
    number = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    start = begin[row] + number * WINDOW
    size = np.minimum(end[row] - start, WINDOW)
    at = start[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < size[:, None]
    folded = ASCII_LOWER[data]
    return np.where(inside, folded[np.minimum(at, max(len(data) - 1, 0))] if len(data) else 0, 0).astype(np.uint8), row, size


@dataclass
class ByteNetwork:
    languages: list[str]
    embedding: np.ndarray
    filters: np.ndarray
    filter_bias: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    @classmethod
    def new(cls, languages: list[str], seed: int = 0) -> ByteNetwork:
        rng = np.random.default_rng(seed)
        wide, total = max(WIDTHS), FILTERS * len(WIDTHS)
        filters = rng.normal(0, 0.3, (wide * DIMENSIONS, total)).astype(np.float32) * cls.shape()
        return cls(languages, rng.normal(0, 0.5, (256, DIMENSIONS)).astype(np.float32), filters, np.zeros(total, np.float32), rng.normal(0, 0.2, (total, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))

    @staticmethod
    def shape() -> np.ndarray:
        """1 where a filter has a weight: narrow filters see the first bytes of a patch."""
        keep = [np.arange(max(WIDTHS) * DIMENSIONS) < w * DIMENSIONS for w in WIDTHS for _ in range(FILTERS)]
        return np.array(keep).T.astype(np.float32)

    def _pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        embedded = self.embedding[windows]
        n, wide = len(windows), max(WIDTHS)
        patches = np.lib.stride_tricks.as_strided(embedded, (n, WINDOW - wide + 1, wide * DIMENSIONS), (embedded.strides[0], embedded.strides[1], embedded.itemsize))
        return (np.ascontiguousarray(patches).reshape(-1, wide * DIMENSIONS) @ self.filters).reshape(n, WINDOW - wide + 1, -1), patches

    def _softmax(self, pooled: np.ndarray) -> np.ndarray:
        z = pooled @ self.weights + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = [np.zeros((0, len(self.languages)), np.float32)]
        for i in range(0, len(windows), _BATCH):
            response, _ = self._pooled(windows[i : i + _BATCH])
            out.append(self._softmax(np.maximum(response.max(1) + self.filter_bias, 0)))
        return np.concatenate(out)

    def train(self, windows: np.ndarray, target: np.ndarray, epochs: int = 12, rate: float = 0.01, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        names = ("embedding", "filters", "filter_bias", "weights", "bias")
        first, second = ({k: np.zeros_like(getattr(self, k)) for k in names} for _ in range(2))
        step, shape, wide = 0, self.shape(), max(WIDTHS)
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for lo in range(0, len(order), 64):
                own = order[lo : lo + 64]
                w = windows[own]
                response, patches = self._pooled(w)
                best = response.argmax(1)
                raw = np.take_along_axis(response, best[:, None], 1)[:, 0] + self.filter_bias
                pooled = np.maximum(raw, 0)
                d = self._softmax(pooled)
                d[np.arange(len(own)), target[own]] -= 1
                d /= len(own)
                back = (d @ self.weights.T) * (raw > 0)
                chosen = patches[np.arange(len(own))[:, None], best]
                grad = {"weights": pooled.T @ d, "bias": d.sum(0), "filter_bias": back.sum(0), "filters": np.einsum("nf,nfk->kf", back, chosen) * shape}
                g = np.zeros_like(self.embedding)
                at = best[:, :, None] + np.arange(wide)
                share = back[:, :, None, None] * self.filters.T.reshape(1, -1, wide, DIMENSIONS)
                np.add.at(g, w[np.arange(len(own))[:, None, None], at], share)
                grad["embedding"] = g
                step += 1
                for k in names:
                    first[k] = 0.9 * first[k] + 0.1 * grad[k]
                    second[k] = 0.999 * second[k] + 0.001 * grad[k] ** 2
                    move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                    setattr(self, k, (getattr(self, k) - rate * move).astype(np.float32))


def has_letter(chunk: Chunk) -> np.ndarray:
    counts = np.concatenate([[0], np.cumsum(_LETTER[chunk.data])])
    out = counts[chunk.end] > counts[chunk.begin]
    for i in np.flatnonzero(~out & (chunk.end > chunk.begin)):
        out[i] = any(c.isalpha() for c in chunk.data[chunk.begin[i] : chunk.end[i]].tobytes().decode("utf-8", "replace"))
    return out


def _training_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (doc_id, lang, text) up to PER_TEXT windows of each text, at places drawn over all of it."""
    for batch in batches:
        ids, langs, places, out = [], [], [], []
        for chunk in chunks(batch.column(2)):
            lettered = has_letter(chunk)
            for i in np.flatnonzero(lettered):
                a, b = int(chunk.begin[i]), int(chunk.end[i])
                doc_id = batch.column(0)[chunk.lo + int(i)].as_py()
                room = max(0, b - a - WINDOW)
                seeds = mix(np.arange(PER_TEXT, dtype=np.uint64) + np.uint64(zlib.crc32(str(doc_id).encode())) * np.uint64(PER_TEXT))
                for at in sorted({int(s % np.uint64(room + 1)) for s in seeds}):
                    piece = chunk.data[a + at : min(b, a + at + WINDOW)]
                    if _LETTER[piece].any() or not _LETTER[chunk.data[a:b]].any():
                        ids.append(doc_id)
                        langs.append(batch.column(1)[chunk.lo + int(i)].as_py())
                        places.append(at)
                        out.append(piece.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(langs, pa.string()), pa.array(places, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "lang", "at", "window"])


def train_language_id(docs: DataFrame, bound: int = BOUND) -> ByteNetwork | None:
    """A network trained on rows (doc_id, text, lang) that are not held out; None if there are none."""
    # texts without a letter teach nothing, so they are not sampled either
    learn = docs.where(~held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    ids = sample_ids(learn, "lang", bound // PER_TEXT).select(F.col("doc_id").alias("picked"), F.col("lang").alias("as_lang"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    picked = learn.join(F.broadcast(ids), (F.col("doc_id") == F.col("picked")) & (F.col("lang") == F.col("as_lang")))  # about `bound` ids
    picked = picked.groupBy("doc_id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # one text for an id, however often it is there
    rows = picked.mapInArrow(_training_windows, f"doc_id {kind}, lang string, at bigint, window binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.lang, r.doc_id, r.at, bytes(r.window)))
    languages = sorted({r.lang for r in rows})
    windows = np.zeros((len(rows), WINDOW), np.uint8)
    for i, r in enumerate(rows):
        windows[i, : len(r.window)] = ASCII_LOWER[np.frombuffer(bytes(r.window), np.uint8)]
    network = ByteNetwork.new(languages)
    network.train(windows, np.array([languages.index(r.lang) for r in rows]))
    return network


def _classify(batches: Iterator[pa.RecordBatch], network: ByteNetwork | None, text_at: int, keep: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        preds, scores = [], []
        for chunk in chunks(batch.column(text_at), 256 << 10):
            n = len(chunk.begin)
            known = has_letter(chunk)
            end = np.where(known, chunk.end, chunk.begin)
            pred, score = np.full(n, "und", object), np.zeros(n)
            if network is not None and known.any():
                total = np.zeros((n, len(network.languages)))
                for lo in range(0, n, 256):  # a single long text is cut further below
                    hi = min(n, lo + 256)
                    for part in range(0, int((end[lo:hi] - chunk.begin[lo:hi]).max(initial=0)), 1 << 20):
                        b = np.minimum(chunk.begin[lo:hi] + part, end[lo:hi])
                        windows, row, size = cut(chunk.data, b, np.minimum(b + (1 << 20), end[lo:hi]))
                        np.add.at(total, row + lo, network.probabilities(windows) * size[:, None])
                best = total.argmax(1)
                mass = np.maximum(total.sum(1), 1)
                pred = np.where(known, np.array(network.languages, object)[best], pred)
                score = np.where(known, np.clip(total[np.arange(n), best] / mass, 0, 1), 0.0)
            preds += pred.tolist()
            scores.append(score)
        if scores:
            columns = [batch.column(batch.schema.names.index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(preds, pa.string()), pa.array(np.concatenate(scores))], names=[*keep, "lang_pred", "score"])


def classify_language(docs: DataFrame, network: ByteNetwork | None, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` (default doc_id) with lang_pred and score."""
    carry = list(carry or ["doc_id"])
    if clash := {"lang_pred", "score"} & set(carry):
        raise ValueError(f"carried columns {sorted(clash)} have the names of results")
    own = docs.select(*carry, F.col(text).alias("_text"))
    schema = T.StructType([own.schema[c] for c in carry] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return own.mapInArrow(lambda it: _classify(it, network, len(carry), carry), schema)


def language_report(docs: DataFrame) -> DataFrame:
    network = train_language_id(docs.select("doc_id", "text", "lang"))
    return classify_language(docs, network).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
