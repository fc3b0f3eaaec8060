"""BLEU and chrF++ as summable counts: one Arrow pass over segments, then plain sums.

From the published definitions (Papineni 2002; Popovic 2017; the mteval-v13a tokeniser).
"""

from __future__ import annotations

import math
import re
import string
from collections import defaultdict
from itertools import chain, count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType

from textloom.functions import text as T
from textloom.operators.evaluation import GROUP_ROWS, numbered

COUNTS = ArrayType(LongType())
BLEU_ORDER, CHAR_ORDER, WORD_ORDER, BETA = 4, 6, 2, 2
BLEU_SIZE, CHRF_SIZE = 2 + 2 * BLEU_ORDER, 3 * (CHAR_ORDER + WORD_ORDER)


def _plain_13a(line: str) -> str:
    line = line.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for entity, sign in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        line = line.replace(entity, sign)
    return line


def _split_13a(line: str) -> list[str]:
    line = re.sub(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 ", f" {line} ")
    line = re.sub(r"([^0-9])([\.,])", r"\1 \2 ", line)
    line = re.sub(r"([\.,])([^0-9])", r" \1 \2", line)
    return re.sub(r"([0-9])(-)", r"\1 \2 ", line).split()


def _word_13a(word: str) -> list[str]:
    """_split_13a of one word, without its rules for words of letters and digits alone or before a full stop or comma."""
    if word.isalnum():
        return [word]
    return [word[:-1], word[-1]] if word[-1] in ".," and word[:-1].isalnum() else _split_13a(word)


def tokenize_13a(line: str) -> list[str]:
    return _split_13a(_plain_13a(line))


#: Odd constants of the hash of a run of items.
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Pairs that are counted together have about so many characters, and are so many at most: a segment's number stands above the hash.
_PART_CHARS, _PART_PAIRS = 1 << 20, 1 << 14


def _met(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, sides: list[np.ndarray], orders: int) -> np.ndarray:
    """Segments x orders: runs that both sides hold, as multisets. sides: the row of flat of each segment, for both."""
    n = len(sides[0])
    out = np.zeros((n, orders), np.int64)
    rows = np.concatenate(sides)
    size = lengths[rows]
    ends = np.cumsum(size)
    items = flat[np.arange(size.sum()) + np.repeat(starts[rows] - ends + size, size)]
    segment = np.repeat(np.tile(np.arange(n, dtype=np.uint64), 2), size)
    second = np.repeat(np.repeat(np.array([0, 1], np.uint64), n), size)
    left = np.repeat(ends, size) - np.arange(len(items))
    bits = np.uint64(64 - max(1, (n - 1).bit_length()))
    # A segment's number stands above the hash, so runs of different segments never meet; the lowest bit is the side.
    above, hashes = segment << bits | second, np.zeros(len(items), np.uint64)
    for order in range(orders):
        at = np.flatnonzero(left > order)
        h = (hashes[at] + items[at + order] + np.uint64(1)) * _STEP
        hashes[at] = h = h ^ h >> np.uint64(29)
        keys = np.sort(above[at] | (h * _MIX >> np.uint64(64) - bits) & ~np.uint64(1))
        if not len(keys):
            break
        runs = keys & ~np.uint64(1)
        first = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]]))
        total = np.diff(first, append=len(keys))
        several = total > 1
        b = np.add.reduceat(keys & np.uint64(1), first)[several].astype(np.int64)
        both = np.minimum(total[several] - b, b)
        out[:, order] = np.bincount((runs[first[several]] >> bits).astype(np.int64), both, n)
    return out


def _run_counts(rows: list, flat: np.ndarray, h: np.ndarray, r: np.ndarray, orders: int) -> np.ndarray:
    """Pairs x orders x (runs of the first, of the second, of both as multisets) for pairs h, r of rows, whose numbered items are flat."""
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    sizes = np.maximum(np.stack([lengths[h], lengths[r]], 1)[:, None, :] - np.arange(orders)[:, None], 0)
    # All runs of a text that begins the other one are in that too.
    begins = np.fromiter((rows[j][: len(rows[i])] == rows[i] for i, j in zip(h.tolist(), r.tolist(), strict=True)), bool, len(h))
    both = sizes[:, :, 0].copy()
    both[~begins] = _met(flat.astype(np.uint64), np.cumsum(lengths) - lengths, lengths, [h[~begins], r[~begins]], orders)
    return np.concatenate([sizes, both[:, :, None]], axis=2)


class _Words(dict):
    """A word's pieces as numbers, made once for each word."""

    def __init__(self, cut):
        super().__init__()
        self.cut, self.numbers = cut, defaultdict(count().__next__)

    def __missing__(self, word: str) -> list[int]:
        self[word] = found = [self.numbers[piece] for piece in self.cut(word)]
        return found

    def rows(self, texts: list[str]) -> tuple[list[list[int]], np.ndarray]:
        return _with_flat([[n for w in t.split() for n in self[w]] for t in texts])


def _with_flat(rows: list[list[int]]) -> tuple[list[list[int]], np.ndarray]:
    return rows, np.fromiter(chain.from_iterable(rows), np.int64)


def _in_parts(hypotheses: list[str], references: list[str], counts) -> list[list[int]]:
    """Counts of all pairs, a part of them at a time; each text is cut once and equal pairs are counted once in a part. counts gets the texts and the pairs' places there."""
    out, k = [], 0
    ends = np.cumsum(np.fromiter(map(len, hypotheses), np.int64, len(hypotheses)) + np.fromiter(map(len, references), np.int64, len(references)))
    while k < len(hypotheses):
        stop = int(np.searchsorted(ends, (ends[k - 1] if k else 0) + _PART_CHARS))
        stop = min(max(stop, k + 1), k + _PART_PAIRS, len(hypotheses))
        texts: dict[str, int] = defaultdict(count().__next__)
        h, r = (np.fromiter(map(texts.__getitem__, side[k:stop]), np.int64, stop - k) for side in (hypotheses, references))
        pairs, back = np.unique(h * len(texts) + r, return_inverse=True)
        out += counts(list(texts), pairs // len(texts), pairs % len(texts))[back].tolist()
        k = stop
    return out


def bleu_counts_of(hypotheses: list[str], references: list[str], tokenize=tokenize_13a) -> list[list[int]]:
    """For each pair: lengths of both, then matches and totals of each order. tokenize cuts a line to tokens."""

    def counts(texts: list[str], h: np.ndarray, r: np.ndarray) -> np.ndarray:
        if tokenize is tokenize_13a:  # its rules see no further than a word's end
            rows, flat = _Words(_word_13a).rows([_plain_13a(t) for t in texts])
        else:
            numbers: dict[str, int] = defaultdict(count().__next__)
            rows, flat = _with_flat([[numbers[w] for w in tokenize(t)] for t in texts])
        found = _run_counts(rows, flat, h, r, BLEU_ORDER)
        return np.concatenate([found[:, 0, :2], found[:, :, 2], found[:, :, 0]], axis=1)

    return _in_parts(hypotheses, references, counts)


def bleu_counts(hypothesis: str, reference: str) -> list[int]:
    return bleu_counts_of([hypothesis], [reference])[0]


def bleu(counts) -> float:
    h, r, match, total = counts[0], counts[1], counts[2 : 2 + BLEU_ORDER], counts[2 + BLEU_ORDER :]
    if not any(match):
        return 0.0
    logs, halvings = 0.0, 1
    for m, t in zip(match, total, strict=True):
        if not t:
            return 0.0
        if m:
            logs += math.log(100 * m / t)
        else:
            halvings *= 2
            logs += math.log(100 / (halvings * t))
    return (math.exp(1 - r / h) if h < r else 1.0) * math.exp(logs / BLEU_ORDER)


def _chrf_words(text: str) -> list[str]:
    if text.isalnum():
        return [text]
    out = []
    for w in text.split():
        if len(w) > 1 and w[-1] in string.punctuation:
            out += [w[:-1], w[-1]]
        elif len(w) > 1 and w[0] in string.punctuation:
            out += [w[0], w[1:]]
        else:
            out.append(w)
    return out


def chrf_counts_of(hypotheses: list[str], references: list[str]) -> list[list[int]]:
    """For each pair: totals of both and matches, for each character and word order."""

    def counts(texts: list[str], h: np.ndarray, r: np.ndarray) -> np.ndarray:
        letters = ["".join(t.split()) for t in texts]
        found = _run_counts(letters, np.frombuffer("".join(letters).encode("utf-32-le", "surrogatepass"), np.uint32), h, r, CHAR_ORDER)
        return np.concatenate([found, _run_counts(*_Words(_chrf_words).rows(texts), h, r, WORD_ORDER)], axis=1).reshape(len(h), CHRF_SIZE)

    return _in_parts(hypotheses, references, counts)


def chrf_counts(hypothesis: str, reference: str) -> list[int]:
    return chrf_counts_of([hypothesis], [reference])[0]


def chrf(counts) -> float:
    precision = recall = orders = 0.0
    for h, r, m in zip(counts[0::3], counts[1::3], counts[2::3], strict=True):
        if h and r:
            precision, recall, orders = precision + m / h, recall + m / r, orders + 1
    if not orders or precision + recall == 0:
        return 0.0
    p, r = precision / orders, recall / orders
    return 100 * (1 + BETA**2) * p * r / (BETA**2 * p + r) if p + r else 0.0


def bleu_stats(hypothesis, reference, tokenize=tokenize_13a) -> Column:
    """tokenize cuts a line to tokens; with a subword model's it gives the counts of spBLEU."""

    @F.pandas_udf(COUNTS)
    def counts(h: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series(bleu_counts_of(h.fillna("").tolist(), r.fillna("").tolist(), tokenize))

    return counts(hypothesis, reference)


@F.pandas_udf(COUNTS)
def chrf_stats(h: pd.Series, r: pd.Series) -> pd.Series:
    return pd.Series(chrf_counts_of(h.fillna("").tolist(), r.fillna("").tolist()))


@F.pandas_udf(DoubleType())
def sentence_chrf(h: pd.Series, r: pd.Series) -> pd.Series:
    """chrF++ of each pair, to two digits."""
    return pd.Series([round(chrf(c), 2) for c in chrf_counts_of(h.fillna("").tolist(), r.fillna("").tolist())], dtype=float)


@F.pandas_udf(DoubleType())
def bleu_score(counts: pd.Series) -> pd.Series:
    return counts.map(lambda c: round(bleu(list(c)), 2))


@F.pandas_udf(DoubleType())
def chrf_score(counts: pd.Series) -> pd.Series:
    return counts.map(lambda c: round(chrf(list(c)), 2))


def _sums(stats: str, size: int) -> Column:
    return F.array(*(F.sum(F.get(stats, F.lit(i))) for i in range(size)))


def corpus_scores(pairs: DataFrame) -> DataFrame:
    """system, n, bleu, chrf of pairs(system, hyp, ref)."""
    counted = pairs.select("system", bleu_stats("hyp", "ref").alias("b"), chrf_stats("hyp", "ref").alias("c"))
    sums = counted.groupBy("system").agg(F.count(F.lit(1)).alias("n"), _sums("b", BLEU_SIZE).alias("b"), _sums("c", CHRF_SIZE).alias("c"))
    return sums.select("system", "n", bleu_score("b").alias("bleu"), chrf_score("c").alias("chrf"))


def check_lengths(predictions: DataFrame, references: DataFrame, key: str) -> None:
    """An error if a system lacks a segment of references or has one more."""
    n = references.count()
    wrong = predictions.join(references.select(key), key, "left_semi").groupBy("system").agg(F.count_distinct(key).alias("n"))
    wrong = wrong.join(predictions.groupBy("system").agg(F.count(F.lit(1)).alias("rows")), "system", "full").where((F.coalesce("n", F.lit(0)) != n) | (F.col("rows") != n))
    if rows := wrong.select("system", "rows").collect():
        raise ValueError(f"length mismatch with {n} references: {sorted((r['system'], r['rows']) for r in rows)}")


def robustness(pairs: DataFrame, least_words: tuple[int, ...] = (0, 5, 10)) -> DataFrame:
    """min_words, system, n, chrf of pairs(system, src, hyp, ref): corpus chrF++ of the segments whose source has that many words or more. Counts are made once for all subsets."""
    counted = pairs.select("system", T.count_words(F.col("src")).alias("words"), chrf_stats("hyp", "ref").alias("c"))
    subsets = F.explode(F.filter(F.array(*map(F.lit, least_words)), lambda n: F.col("words") >= n)).alias("min_words")
    sums = counted.select("system", subsets, "c").groupBy("min_words", "system").agg(F.count(F.lit(1)).alias("n"), _sums("c", CHRF_SIZE).alias("c"))
    return sums.select("min_words", "system", "n", chrf_score("c").alias("chrf"))


def _interval(deltas: np.ndarray, digits: int) -> dict:
    low, high = np.percentile(deltas, [2.5, 97.5])
    return {"ci95": [round(float(low), digits), round(float(high), digits)], "p_value": float(np.mean(deltas <= 0))}


def paired_bootstrap(a: np.ndarray, b: np.ndarray, closing, samples: int = 1000, seed: int = 13, digits: int = 2, metric: str = "") -> dict:
    """metric, a_score, b_score, delta, ci95 and p_value of b against a over resampled segments; a and b are segments x counts, closing turns summed counts to a score."""
    if len(a) != len(b):
        raise ValueError("length mismatch between the systems")
    rng, n, deltas = np.random.default_rng(seed), len(a), np.empty(samples)
    for k in range(samples):
        at = rng.integers(0, n, size=n)
        deltas[k] = closing(b[at].sum(0)) - closing(a[at].sum(0))
    first, second = closing(a.sum(0)), closing(b.sum(0))
    return {"metric": metric, "a_score": round(float(first), digits), "b_score": round(float(second), digits), "delta": round(float(second - first), digits), **_interval(deltas, digits)}


def paired_bootstrap_segments(a, b, samples: int = 1000, seed: int = 13, metric: str = "comet") -> dict:
    """The same of the means of segment scores, to four digits."""
    if len(a) != len(b):
        raise ValueError("length mismatch between the systems")
    a, b = np.asarray(a, float), np.asarray(b, float)
    rng, n = np.random.default_rng(seed), len(a)
    deltas = np.array([b[at].mean() - a[at].mean() for at in (rng.integers(0, n, size=n) for _ in range(samples))])
    return {"metric": metric, "a_score": round(float(a.mean()), 4), "b_score": round(float(b.mean()), 4), "delta": round(float(b.mean() - a.mean()), 4), **_interval(deltas, 4)}


def per_segment(scored: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """keys, scores: a map from system to score for each segment."""
    return scored.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("system", F.col(score))))).alias("scores"))


def evaluate(pairs: DataFrame, meta: DataFrame | None = None, labels: DataFrame | None = None, neural: DataFrame | None = None) -> DataFrame:
    """system, label, n, bleu, chrf, the columns of meta, comet: a row for each system of pairs(system, seg, hyp, ref).

    A label comes from labels(system, label), else from meta, else it is the name. neural(system,
    score) has segment scores, whose mean is comet.
    """
    out = corpus_scores(pairs)
    own = None
    if meta is not None:
        out = out.join(meta.withColumnRenamed("label", "__meta_label") if "label" in meta.columns else meta, "system", "left")
        own = "__meta_label" if "label" in meta.columns else None
    if labels is not None:
        out = out.join(labels.select("system", F.col("label").alias("__label")), "system", "left")
    names = [F.col(c) for c in ("__label" if labels is not None else None, own, "system") if c]
    out = out.withColumn("label", F.coalesce(*names)).drop("__label", "__meta_label")
    return out if neural is None else out.join(neural.groupBy("system").agg(F.round(F.avg("score"), 4).alias("comet")), "system", "left")


def significance(pairs: DataFrame, comparisons: list[tuple[str, str]], samples: int = 1000, seed: int = 13) -> list[dict]:
    """Paired bootstrap of BLEU and chrF++ for each comparison whose systems are both there. The counts of a test set, a row for each segment, come to the driver."""
    stats: dict[str, dict[str, list]] = {}
    wanted = {s for pair in comparisons for s in pair}
    rows = pairs.where(F.col("system").isin(*wanted)).select("system", "seg", bleu_stats("hyp", "ref").alias("bleu"), chrf_stats("hyp", "ref").alias("chrf")).orderBy("seg").collect()
    for r in rows:
        of = stats.setdefault(r["system"], {"bleu": [], "chrf": []})
        of["bleu"].append(r["bleu"])
        of["chrf"].append(r["chrf"])
    out = []
    for a, b in comparisons:
        if a in stats and b in stats:
            for metric, closing in (("bleu", bleu), ("chrf", chrf)):
                out.append({"a": a, "b": b, **paired_bootstrap(np.array(stats[a][metric]), np.array(stats[b][metric]), closing, samples, seed, metric=metric)})
    return out


def hash_bootstrap(rows: DataFrame, key: str, value: str, samples: int) -> DataFrame:
    """sample, mean of value over n draws with replacement, each draw a hash of sample and place. Draws are summed by place before they meet the rows."""
    values = rows.select(F.col(key), F.col(value).cast("double").alias("v"))
    placed = numbered(values, [key], F.floor(F.col(key) / GROUP_ROWS), "at").select("at", "v")
    n = rows.count()
    draws = rows.sparkSession.range(samples * n).select(F.floor(F.col("id") / n).alias("sample"), F.pmod(F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("long"), F.lit(n)).alias("at"))
    counts = draws.groupBy("sample", "at").agg(F.count(F.lit(1)).alias("k"))
    return counts.join(placed, "at").groupBy("sample").agg((F.sum(F.col("v") * F.col("k")) / n).alias("mean"))
