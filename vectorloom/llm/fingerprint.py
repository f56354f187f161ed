"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch keeps the k smallest distinct shingle hashes. Sketches of parts merge by union; they
estimate the number of distinct shingles, resemblance and containment. Below k shingles all
estimates are exact.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.llm import text as tx
from vectorloom.llm.shared import cut

SHINGLE_WORDS = 5
K = 128

_TOP = float(1 << 64)


def sketch(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct hashes, ascending."""
    if len(hashes) > 4 * k:
        # distinct values among the smallest; widened until k of them differ
        take = 2 * k
        while take < len(hashes):
            low = np.unique(np.partition(hashes, take)[:take])
            if len(low) >= k:
                return low[:k]
            take *= 4
    return np.unique(hashes)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def distinct_count(s: np.ndarray, k: int = K) -> float:
    return float(len(s)) if len(s) < k else (k - 1) * _TOP / (float(s[k - 1]) + 1.0)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity; two empty sets are alike (1), an empty and another are not (0)."""
    if not len(a) and not len(b):
        return 1.0
    # below this bound both sketches are complete
    both = merge(a, b, k)
    return float(len(np.intersect1d(np.intersect1d(a, b, True), both, True))) / len(both)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    r = resemblance(a, b, k)
    union = distinct_count(merge(a, b, k), k)
    return min(1.0, r * union / distinct_count(a, k))


def to_text(s: np.ndarray) -> str:
    return base64.b64encode(s.astype("<u8").tobytes()).decode()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), "<u8")


def text_sketches(texts: pa.Array, n: int = SHINGLE_WORDS, k: int = K) -> list[np.ndarray]:
    words, bounds, _, _ = tx.word_hashes(texts)
    out, first = tx.all_shingles(words, bounds, n)
    return [sketch(out[first[i] : first[i + 1]], k) for i in range(len(texts))]


def fingerprints(docs: DataFrame, n: int = SHINGLE_WORDS, k: int = K) -> DataFrame:
    """One row per row of docs: doc_id, n_chars, fingerprint (base64 of ascending 64-bit hashes), n_shingles (estimate).

    Null and empty texts have an empty fingerprint; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).fill_null("")
            made = text_sketches(texts, n, k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.compute.utf8_length(texts).cast(pa.int64()), pa.array([to_text(s) for s in made], pa.string()), pa.array([distinct_count(s, k) for s in made], pa.float64())],
                ["doc_id", "n_chars", "fingerprint", "n_shingles"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_chars long, fingerprint string, n_shingles double")


#: Bytes of text that one range of neighbours is meant to hold.
RANGE_BYTES = 4 << 20
#: Quantiles of doc_id that are looked for; beyond them the ids between two are cut evenly.
QUANTILES = 4096
#: Ranges whose edges are broadcast, of some 30 bytes each; more are joined.
BROADCAST_RANGES = 100_000


def _range_number(docs: DataFrame) -> Column:
    """The range of each doc_id, of about RANGE_BYTES of text: 0 for null ids, then ascending.

    Ranges lie between quantiles; where more are needed than these, ids between two quantiles are cut evenly.
    """
    size = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.count("doc_id").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    parts = max(1, -(-int(size["b"] or 0) // RANGE_BYTES))
    doc_id, bounds = F.col("doc_id"), []
    if parts > 1 and size["n"]:
        steps = min(parts, QUANTILES)
        found = docs.agg(F.percentile_approx("doc_id", [i / steps for i in range(1, steps)], 20 * steps).alias("q")).first()["q"]
        bounds = sorted({int(size["lo"]), *found} | {int(size["hi"]) + 1})
    if not bounds:
        return F.when(doc_id.isNull(), F.lit(0)).otherwise(F.lit(1)).cast("long")
    # the bound below an id is looked up among some of them, then among those between
    stride = max(1, round(len(bounds) ** 0.5))
    groups = [bounds[i : i + stride + 1] for i in range(0, len(bounds), stride)]
    longs = lambda values: F.array(*[F.lit(int(v)) for v in values]).cast("array<bigint>")
    heads, nested = longs([g[0] for g in groups]), F.array(*[longs(g) for g in groups])
    at = lambda values: F.size(F.filter(values, lambda b: b <= doc_id))
    outer = F.greatest(at(heads), F.lit(1))
    inner = F.greatest(F.least(at(F.element_at(nested, outer)), F.lit(stride)), F.lit(1))
    cuts = -(-parts // len(bounds))
    number = ((outer - 1) * stride + inner).cast("long")
    if cuts > 1:
        low = F.element_at(F.element_at(nested, outer), inner)
        high = F.coalesce(F.get(F.element_at(nested, outer), inner), low + 1)
        within = F.floor((doc_id - low).cast("double") / (high - low).cast("double") * cuts)
        number = number * cuts + F.least(F.greatest(within, F.lit(0)), F.lit(cuts - 1)).cast("long")
    return F.when(doc_id.isNull(), F.lit(0)).otherwise(number).cast("long")


def neighbour_fingerprints(docs: DataFrame, n: int = SHINGLE_WORDS, k: int = K) -> DataFrame:
    """Fingerprints of each text, of its edited text, and likeness to these and to the next document.

    Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and
    estimates of its distinct shingles (n_shingles) and of the share of these that the edited text (in_edited)
    and the next document (in_next) have.
    The edited text has its last floor(n_chars/3) code points replaced by the first as many (or all)
    of the next document, by descending doc_id, null last, equal ids by descending text; after the last
    comes the first. A null text is empty. A table of one row is its own next; an empty one gives none.
    Other columns are ignored.

    Rows are dealt once by ranges of doc_id; the greatest row of each range also goes to the range
    above it, whose last row needs it.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("part", _range_number(rows))
    # the greatest id of each range, and the range above it; after the last comes the first. A row a range
    tops = rows.groupBy("part").agg(F.max("doc_id").alias("top"))
    upward = Window.partitionBy(F.lit(0)).orderBy("part")
    edges = tops.select("part", "top", F.coalesce(F.lead("part").over(upward), F.min("part").over(Window.partitionBy(F.lit(0)))).alias("also"))
    edges = cut(edges, "edges")
    have = edges.count()
    if not have:
        return spark.createDataFrame([], _SCHEMA)
    sent = rows.join(F.broadcast(edges) if have <= BROADCAST_RANGES else edges, "part")
    sent = sent.withColumn("also", F.when(F.col("doc_id").eqNullSafe(F.col("top")), F.col("also")))
    own = F.struct("part", F.lit(False).alias("guest"))
    guest = F.struct(F.col("also").alias("part"), F.lit(True).alias("guest"))
    sent = sent.select("doc_id", "text", F.explode(F.when(F.col("also").isNull(), F.array(own)).otherwise(F.array(own, guest))).alias("x")).select("doc_id", "text", "x.part", "x.guest")
    # guests come after the rows of their range; of several with one id the first by text is the next
    dealt = sent.repartitionByRange(have, "part").sortWithinPartitions("part", "guest", F.col("doc_id").desc_nulls_last(), F.col("text").desc())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # (part, doc_id, text, sketch) that waits for its next
        for batch in batches:
            for lo, hi in _slices(batch.column(1)):
                piece = batch.slice(lo, hi - lo)
                out = []
                sketches = text_sketches(piece.column(1), n, k)
                for doc_id, text, part, is_guest, own_sketch in zip(*(piece.column(i).to_pylist() for i in range(4)), sketches, strict=True):
                    if last is not None and last[0] == part:
                        out.append((last[1], last[2], last[3], text, own_sketch))
                        last = None
                    if not is_guest:
                        last = (part, doc_id, text, own_sketch)
                if out:
                    yield _finish(out, n, k)

    return dealt.mapInArrow(run, _SCHEMA)


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double, in_edited double, in_next double"


def _slices(column: pa.Array, size: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows of about size bytes."""
    _, at = tx.buffers(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, side="right")) - 1)
        yield lo, min(hi, len(column))
        lo = hi


def _finish(rows: list[tuple], n: int, k: int) -> pa.RecordBatch:
    edited = []
    for _, text, _, following, _ in rows:
        cut = len(text) // 3
        edited.append(text[: len(text) - cut] + following[:cut])
    changed = text_sketches(pa.array(edited, pa.large_string()), n, k)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([len(r[1]) for r in rows], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
            pa.array([to_text(r[2]) for r in rows], pa.string()),
            pa.array([to_text(s) for s in changed], pa.string()),
            pa.array([resemblance(r[2], s, k) for r, s in zip(rows, changed, strict=True)], pa.float64()),
            pa.array([resemblance(r[2], r[4], k) for r in rows], pa.float64()),
            pa.array([distinct_count(r[2], k) for r in rows], pa.float64()),
            pa.array([containment(r[2], s, k) for r, s in zip(rows, changed, strict=True)], pa.float64()),
            pa.array([containment(r[2], r[4], k) for r in rows], pa.float64()),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_shingles", "in_edited", "in_next"],
    )
