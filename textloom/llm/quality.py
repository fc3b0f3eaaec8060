"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Tokens are runs of letters, digits or signs, each with a second token for its shape (case, digits,
signs), hashed to a fixed number of buckets. A bucket's vector is the sum of the sparse index vectors
of the buckets seen beside it in the training texts, plus its own. A document is the mean of its
tokens' vectors with their spread, how often words come again at once, and its length. The network's
logit is divided by a temperature that fits its probabilities to a part of the training rows kept
apart. Texts are read a batch at a time by array operations on bytes; nothing is kept from batch to
batch but the network.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import give_back, map_arrow, text_or_empty
from textloom.llm.runs import PIECE, factor, hashes, mixed

#: Labelled rows that the model is fitted on at most, those of least hash; the bound keeps the driver's work fixed.
MAX_TRAINING_ROWS = 3000
BUCKETS, DIMENSIONS, NONZERO, WINDOW = 1 << 15, 32, 4, 2
_TOP = np.uint64(65 - BUCKETS.bit_length())
HIDDEN, EPOCHS, SEED = 24, 400, 7
FEATURES = 4 * DIMENSIONS + 4
THRESHOLD = 0.3
#: Tokens whose vectors are summed together: 1 MB of them.
TOKENS_TOGETHER = 1 << 12

#: Kinds of bytes: 0 white space, then letters (all of other characters' bytes too), digits, signs, underscores.
_KINDS = np.full(256, 3, np.uint8)
_KINDS[[*range(9, 14), *range(28, 33)]] = 0
_KINDS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KINDS[48:58] = 2
_KINDS[95] = 4
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_GAP = re.compile(rb"\s")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row's label must not be learnt from: crc32(doc_id as text) mod 5 is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def _shapes(piece: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each token's shape: digits by their count, signs by the first and their count, letters by case and length."""
    size, first = ends - starts, piece[starts].astype(np.int64)
    kind = _KINDS[first]
    upper = np.append(0, np.cumsum(_UPPER[piece]))
    upper = upper[ends] - upper[starts]
    case = np.where(upper == 0, 0, np.where((upper == size) & (size > 1), 1, np.where((upper == 1) & (_UPPER[first] == 1), 2, 3)))
    letters = 10 + case * 5 + np.minimum(size // 4, 4)
    return np.where(kind == 2, np.minimum(size, 4), np.where(kind == 1, letters, 1000 + first * 4 + np.minimum(size, 4)))


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of all texts' words, those of their shapes, and where each text begins among them, with the end."""
    coded = [text.encode("utf-8", "surrogatepass") for text in texts]
    data = b"\n".join(coded)
    begins = np.cumsum([0, *(len(c) + 1 for c in coded)])
    words, shapes, places, at = [], [], [], 0
    while at < len(data):
        end = at + PIECE
        if end < len(data):
            gap = _GAP.search(data, end)
            end = gap.start() if gap else len(data)
        piece = np.frombuffer(data[at:end], np.uint8)
        kinds = np.zeros(len(piece) + 2, np.uint8)
        kinds[1:-1] = _KINDS[piece]
        edges = np.flatnonzero(kinds[1:] != kinds[:-1])
        starts, ends = edges[:-1], edges[1:]
        solid = kinds[starts + 1] != 0
        starts, ends = starts[solid], ends[solid]
        words.append((hashes(piece, starts, ends) >> _TOP).astype(np.uint16))
        shapes.append((mixed((_shapes(piece, starts, ends) + 1).astype(np.uint64) * factor(0)) >> _TOP).astype(np.uint16))
        places.append(starts + at)
        at = end
    none = np.zeros(0, np.uint16)
    places = np.concatenate([np.zeros(0, np.int64), *places])
    return np.concatenate([none, *words]), np.concatenate([none, *shapes]), np.searchsorted(places, begins)


def _index_parts() -> tuple[np.ndarray, np.ndarray]:
    """The places and signs of the NONZERO entries of each bucket's index vector."""
    rng = np.random.default_rng(SEED)
    places, signs = np.zeros((NONZERO, BUCKETS), np.int64), np.zeros((NONZERO, BUCKETS))
    for k in range(NONZERO):
        places[k], signs[k] = rng.integers(0, DIMENSIONS, BUCKETS), rng.choice([-1.0, 1.0], BUCKETS)
    return places, signs


def word_vectors(lanes: list[np.ndarray], begins: np.ndarray) -> np.ndarray:
    """Random indexing over the training texts; buckets without any context keep half their own index vector."""
    places, signs = _index_parts()
    every = np.arange(BUCKETS)
    index = sum(np.bincount(every * DIMENSIONS + places[k], signs[k], BUCKETS * DIMENSIONS) for k in range(NONZERO)).reshape(BUCKETS, DIMENSIONS)
    context = np.zeros(BUCKETS * DIMENSIONS)
    text = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    for lane in lanes:
        for gap in range(1, WINDOW + 1):
            same = text[gap:] == text[:-gap]
            left, right = lane[:-gap][same].astype(np.int64), lane[gap:][same].astype(np.int64)
            for a, b in ((left, right), (right, left)):
                for k in range(NONZERO):
                    context += np.bincount(a * DIMENSIONS + places[k][b], signs[k][b], BUCKETS * DIMENSIONS)
    context = context.reshape(BUCKETS, DIMENSIONS)
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    return (context / np.maximum(norm, 1e-6) + 0.5 * index / np.sqrt(NONZERO)).astype(np.float32)


def features(vectors: np.ndarray, texts: list[str]) -> np.ndarray:
    """Per text: means over words and over shapes, the spread of both, how often a word comes again one to three places on, and the length's logarithm.

    A text's row is the same in any company.
    """
    words, shapes, begins = tokens(texts)
    n = np.diff(begins)
    out = np.zeros((len(texts), FEATURES))
    both = np.concatenate([vectors, vectors * vectors], axis=1)
    for lane, buckets in enumerate((words, shapes)):
        at = 2 * lane * DIMENSIONS
        sums = np.zeros((len(texts), 2 * DIMENSIONS))
        for k, (first, end) in enumerate(zip(begins.tolist(), begins[1:].tolist())):
            for low in range(first, end, TOKENS_TOGETHER):
                sums[k] += both.take(buckets[low : min(low + TOKENS_TOGETHER, end)], axis=0).sum(0)
        mean = sums / np.maximum(n, 1)[:, None]
        out[:, at : at + DIMENSIONS] = mean[:, :DIMENSIONS]
        out[:, at + DIMENSIONS : at + 2 * DIMENSIONS] = np.sqrt(np.maximum(mean[:, DIMENSIONS:] - mean[:, :DIMENSIONS] ** 2, 0))
    text = np.repeat(np.arange(len(texts)), n)
    for gap in (1, 2, 3):
        again = text[gap:][(words[gap:] == words[:-gap]) & (text[gap:] == text[:-gap])]
        out[:, 4 * DIMENSIONS + gap - 1] = np.bincount(again, minlength=len(texts)) / np.maximum(n - gap, 1)
    out[:, -1] = np.log1p(n)
    return out


@dataclass
class Network:
    vectors: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh((x - self.center) / self.scale @ self.w1 + self.b1)
        return (hidden @ self.w2 + self.b2) / self.temperature

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def train(texts: list[str], labels: list[int]) -> Network:
    """The same rows in the same order always give the same network. Without both labels, scores follow the share of label 1 (0.5 without rows)."""
    words, shapes, begins = tokens(texts)
    vectors = word_vectors([words, shapes], begins)
    y = np.array(labels, np.float64)
    x = features(vectors, texts)
    center, scale = (x.mean(0), x.std(0) + 1e-3) if len(y) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    rng = np.random.default_rng(SEED)
    net = Network(vectors, center, scale, rng.normal(0, 0.1, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0, 1.0)
    share = (y.sum() + 1) / (len(y) + 2)
    if len(set(labels)) < 2:
        net.b2 = float(np.log(share / (1 - share)))
        return net
    apart = np.arange(len(y)) % 5 == 4
    z, t = (x[~apart] - center) / scale, y[~apart]
    net.b2 = float(np.log(share / (1 - share)))
    net.w2 = rng.normal(0, 0.1, HIDDEN)
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, EPOCHS + 1):
        hidden = np.tanh(z @ params[0] + params[1])
        p = 1 / (1 + np.exp(-np.clip(hidden @ params[2] + params[3][0], -30, 30)))
        error = (p - t) / len(t)
        back = np.outer(error, params[2]) * (1 - hidden**2)
        grads = [z.T @ back + 1e-3 * params[0], back.sum(0), hidden.T @ error + 1e-3 * params[2], np.array([error.sum()])]
        for param, grad, (m, v) in zip(params, grads, moments, strict=True):
            m += 0.1 * (grad - m)
            v += 0.001 * (grad**2 - v)
            param -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    if 0 < y[apart].sum() < apart.sum():
        logits = net.logits(x[apart])

        def loss(temperature: float) -> float:
            return float(np.logaddexp(0, np.where(y[apart] == 1, -1, 1) * logits / temperature).mean())

        net.temperature = min(np.geomspace(1 / 32, 32, 121), key=loss)
    return net


def fit(docs: DataFrame, labels: DataFrame, rows: int = MAX_TRAINING_ROWS) -> Network:
    """Learns from at most rows labelled documents outside the held-out fold, those of least hash.

    Labels other than 0 and 1, null ids and null labels are passed over; a doc_id with several
    labels counts once, with the least of them; of several documents with one doc_id, each counts.
    """
    known = labels.select(F.col("doc_id").alias("label_id"), "quality").where(F.col("quality").isin(0, 1) & F.col("label_id").isNotNull() & ~held_out("label_id"))
    known = known.groupBy("label_id").agg(F.min("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("label_id"), "label_id").limit(rows)  # at most `rows` pairs of numbers
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"))
    taken = texts.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(rows).select("text", "quality").collect()
    network = train([r["text"] for r in taken], [r["quality"] for r in taken])
    del taken
    give_back()  # training takes much more than what it leaves, and the driver goes on
    return network


def score(docs: DataFrame, network: Network) -> DataFrame:
    """docs with the columns score and predicted added; columns of those names give way.

    A null text counts as empty; an empty text gets the score of a document without tokens. Equal
    texts get equal scores. Rows are never joined or moved, so repeated and null ids do no harm.
    """
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    docs = docs.select(*keep)
    at = keep.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(network)  # of fixed size: BUCKETS x DIMENSIONS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in batches:
            scores = net.scores(features(net.vectors, [text or "" for text in batch.column(at).to_pylist()]))
            added = [pa.array(scores, pa.float64()), pa.array((scores >= THRESHOLD).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*keep, "score", "predicted"])

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return map_arrow(docs, run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= THRESHOLD) of every document."""
    plain = docs.select("doc_id", "text")
    return score(plain, fit(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't reject, with their own columns."""
    columns = docs.columns
    hidden = [c for c in columns if c in ("score", "predicted")]
    scored = score(docs.withColumnsRenamed({c: f"__own_{c}" for c in hidden}), fit(docs, labels))
    kept = scored.where("predicted = 1").drop("score", "predicted")
    return kept.withColumnsRenamed({f"__own_{c}": c for c in hidden}).select(*columns)
