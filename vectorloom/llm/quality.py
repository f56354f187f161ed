"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are complete binary trees kept as flat arrays, so that numpy moves all rows of a batch down one
level at a time. The model is fitted on the driver from a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.llm import text as tx

#: Labelled rows that the model is fitted on, at most; chosen by a hash of the id.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0

NAMES = (
    "log_bytes", "log_words", "log_lines", "word_length", "word_length_deviation", "upper", "digit", "space", "end_marks", "symbols",
    "pipes", "bangs", "non_ascii", "letters", "byte_entropy", "distinct_words", "top_word", "distinct_pairs", "distinct_triples",
    "line_length", "distinct_lines", "symbol_ended", "mark_ended", "upper_first", "one_letter", "long_words", "distinct_bytes",
)

_UPPER, _DIGIT, _LOWER = np.zeros(256), np.zeros(256), np.zeros(256)
_UPPER[65:91] = 1
_DIGIT[48:58] = 1
_LOWER[97:123] = 1


def _of(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars)] = 1
    return out


_SPACE, _MARKS, _SYMBOLS = _of(b" \t\n\x0b\x0c\r"), _of(b".,;:?"), _of(b"#$%&*@^~<>=+/\\_{}[]|`")
_HIGH = np.zeros(256)
_HIGH[128:] = 1
_IS_MARK, _IS_SYMBOL, _IS_UPPER = _MARKS > 0, (_SYMBOLS + _of(b"!")) > 0, _UPPER > 0


def _repetition(hashes: np.ndarray) -> tuple[float, float]:
    """(share of distinct values, share of the commonest)."""
    if not len(hashes):
        return 1.0, 0.0
    ordered = np.sort(hashes)
    edges = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1], [True])))
    return (len(edges) - 1) / len(hashes), float(np.diff(edges).max()) / len(hashes)


def features(texts: pa.Array) -> np.ndarray:
    """A row of statistics per text, from the whole text; a null or empty text has zeros and full distinctness."""
    raw, at = tx.buffers(texts)
    words, bounds, starts, ends = tx.word_hashes_of(raw, at)
    pairs, pair_at = tx.all_shingles(words, bounds, 2)
    triples, triple_at = tx.all_shingles(words, bounds, 3)
    n = len(texts)
    out = np.zeros((n, len(NAMES)))
    lengths = (ends - starts).astype(np.float64)
    last, first = (raw[ends - 1], raw[starts]) if len(starts) else (raw[:0], raw[:0])
    last_mark, last_symbol, first_upper = _IS_MARK[last], _IS_SYMBOL[last], _IS_UPPER[first]
    breaks = np.flatnonzero(raw == 10)
    for i in range(n):
        lo, hi, a, b = at[i], at[i + 1], bounds[i], bounds[i + 1]
        size, count = hi - lo, b - a
        counts = np.bincount(raw[lo:hi], minlength=256)
        share = counts / max(1, size)
        used = share[share > 0]
        cuts = breaks[np.searchsorted(breaks, lo) : np.searchsorted(breaks, hi)]
        line_at = np.concatenate(([lo], cuts + 1))
        line_words = np.searchsorted(starts[a:b], line_at)
        # a line is known by the sum of its words, each weighted by its place
        if count:
            place = np.arange(count, dtype=np.uint64) - np.repeat(line_words, np.diff(np.append(line_words, count))).astype(np.uint64)
            running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words[a:b] * (place * np.uint64(2) + np.uint64(1)))))
            lines = running[np.append(line_words[1:], count)] - running[line_words]
            lines = lines[np.diff(np.append(line_words, count)) > 0]
        else:
            lines = words[:0]
        distinct, top = _repetition(words[a:b])
        w = lengths[a:b]
        out[i] = (
            np.log1p(size), np.log1p(count), np.log1p(len(line_at)), w.mean() if count else 0, w.std() if count else 0,
            share @ _UPPER, share @ _DIGIT, share @ _SPACE, share @ _MARKS, share @ _SYMBOLS, share[124], share[33], share @ _HIGH, share @ _LOWER,
            -(used * np.log2(used)).sum(), distinct, top, _repetition(pairs[pair_at[i] : pair_at[i + 1]])[0], _repetition(triples[triple_at[i] : triple_at[i + 1]])[0],
            np.log1p(size / len(line_at)), _repetition(lines)[0], last_symbol[a:b].mean() if count else 0, last_mark[a:b].mean() if count else 0,
            first_upper[a:b].mean() if count else 0, (w == 1).mean() if count else 0, (w > 14).mean() if count else 0, len(used),
        )
    return out


@dataclass(frozen=True)
class Trees:
    """feature and threshold: (trees, 2^depth - 1); leaf: (trees, 2^depth). A row goes right above the threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1] if self.feature.size else 0
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while inner and node.size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, ridge: float = 1.0, least: float = 1.0) -> Trees:
    """Newton boosting of logistic loss with histogram splits. No rows or one class give a constant."""
    n = len(y)
    prior = (y.sum() + 0.5) / (n + 1.0)
    base = float(np.log(prior / (1 - prior)))
    if n == 0 or y.min() == y.max():
        return Trees(np.zeros((0, 0), int), np.zeros((0, 0)), np.zeros((0, 1)), base)
    width = x.shape[1]
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)])  # x > edges[b] iff bin > b
    inner = 2**depth - 1
    features_, thresholds, leaves = np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    margin = np.full(n, base)
    for t in range(trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)  # within its level
        for level in range(depth):
            many = 2**level
            best = np.full(many, 1e-6)
            choice, cut = np.zeros(many, int), np.full(many, bins)
            for f in range(width):
                key = node * bins + binned[f]
                left_g = np.bincount(key, g, many * bins).reshape(many, bins).cumsum(1)
                left_h = np.bincount(key, h, many * bins).reshape(many, bins).cumsum(1)
                all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
                gain[(left_h < least) | (all_h - left_h < least)] = 0
                at = gain.argmax(1)
                found = gain[np.arange(many), at]
                better = found > best
                best[better], choice[better], cut[better] = found[better], f, at[better]
            for k in range(many):
                spot = many - 1 + k
                features_[t, spot] = choice[k]
                if cut[k] < len(edges[choice[k]]):
                    thresholds[t, spot] = edges[choice[k]][cut[k]]
            node = 2 * node + (binned[choice[node], np.arange(n)] > cut[node])
        sum_g, sum_h = np.bincount(node, g, inner + 1), np.bincount(node, h, inner + 1)
        leaves[t] = rate * sum_g / (sum_h + ridge)
        margin += leaves[t][node]
    return Trees(features_, thresholds, leaves, base)


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


def _parts(texts: pa.Array, size: int = 4 << 20) -> Iterator[pa.Array]:
    _, at = tx.buffers(texts)
    lo = 0
    while lo < len(texts):
        hi = min(len(texts), max(lo + 1, int(np.searchsorted(at, at[lo] + size, side="right")) - 1))
        yield texts.slice(lo, hi - lo)
        lo = hi


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Fits on labelled documents outside the held-out fold: at most sample_rows labels, by a hash of their id.

    Labels that are null or that have no document, and documents with a null id, are not used.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT))
    known = known.select("doc_id", F.col("quality").cast("double").alias("quality"), F.md5(F.col("doc_id").cast("string").cast("binary")).alias("_order"))
    sample = known.orderBy("_order", "doc_id", "quality").limit(sample_rows)
    # sample_rows bounds what is broadcast and what is collected
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in _parts(batch.column(2)):
                x = features(part)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), batch.column(1).slice(at, len(part)), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "quality", "x"]
                )
                at += len(part)

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = rows.mapInArrow(run, f"doc_id {kind}, quality double, x array<double>")
    # ids that stand in several rows give more rows than labels: the limit is in the plan
    found = made.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id", "quality", "x").limit(sample_rows).toArrow()
    x = np.array(found["x"].to_pylist(), dtype=np.float64).reshape(-1, len(NAMES))
    y = (found["quality"].to_numpy() > 0).astype(np.float64)
    order = np.lexsort((*x.T, y, found["doc_id"].to_numpy())) if len(y) else np.zeros(0, int)
    return fit(x[order], y[order])


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1), predicted.

    Scores depend on the text alone: equal texts score alike, null and empty texts too. Repeated rows
    each get a row, an empty table none; other columns are ignored. held_out is null for a null doc_id.
    """
    model = fit_quality(docs, labels)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in _parts(batch.column(2)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), batch.column(1).slice(at, len(part)), pa.array(model.score(features(part)))], ["doc_id", "held_out", "score"])
                at += len(part)

    rows = docs.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_rejected(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose text scores at least threshold.

    Equal texts share their fate, repeated rows too; null and empty texts are scored like others. Without usable
    labels every text has one score, the prior's 0.5, and stays. An empty table stays empty.
    """
    model = fit_quality(docs, labels)
    column = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in _parts(batch.column(column)):
                keep = model.score(features(part)) >= threshold
                yield batch.slice(at, len(part)).filter(pa.array(keep))
                at += len(part)

    return docs.mapInArrow(run, docs.schema)
