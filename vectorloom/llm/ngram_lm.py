"""Language-model scoring by an Elias-Fano n-gram trie.

1. Words are counted in shards by hash. A task writes the words of a shard, as Elias-Fano sequences of
   their hashes and running counts, to the shared folder.
2. Documents are written once as slices: the distinct known words of some MB of text and the places of
   its tokens among them.
3. Each slice sends its distinct pairs and triples, with their counts in training documents, to shards by
   first word; words that very many tokens have are shared out among several shards. A task merges what a
   shard gets, writes the pairs and triples seen in training as trie levels - children relative to their
   context as monotone sequences, quantised smoothed probabilities - maps them, and looks up whatever the
   slices asked for by successor search among the children of its context.
4. The answers meet their slice again and give the scores of its documents.

So no task opens more than one shard, and all n-grams seen in training are kept.

Probabilities are interpolated, with absolute discounting, down to add-one unigrams. They are rounded
down to 16-bit codes before the back-off weights are made, so that each distribution stays within 1.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.llm import text as tx
from vectorloom.llm.elias_fano import EliasFano, drop_file, map_arrays, write_arrays
from vectorloom.llm.shared import cut, new_path, run_once

FOLDS, HELD_OUT = 7, 2
DISCOUNT = 0.75
#: Text bytes that one shard is made of.
SHARD_BYTES = 16 << 20
#: Tokens of one word that a shard is meant to hold; a word that has more is shared out.
HOT_TOKENS = 250_000
#: Text bytes of one slice; a longer text is a slice of its own.
SLICE_BYTES = 8 << 20
#: Keys that a task gathers before it sends them.
FLUSH_KEYS = 2_000_000
#: Values that are looked up together, so that what is worked on stays in the cache.
CHUNK = 1 << 16

_U = np.uint64
END = tx.mix(np.array([0x5851F42D4C957F2D], dtype=np.uint64))[0]
#: Stands for a word that training does not know, and for what follows the end of a text.
NO_WORD = (1 << 32) - 1
_DEPTH = 40.0
_CODES = np.exp2(np.arange(65536) / 65535 * _DEPTH - _DEPTH)
_CODES[0] = 0.0


def encode(p: np.ndarray) -> np.ndarray:
    """16-bit codes of probabilities, rounded down; 0 is 0."""
    with np.errstate(divide="ignore"):
        code = np.floor((np.log2(p) + _DEPTH) / _DEPTH * 65535 + 1e-9)
    return np.where(p > 0, np.clip(code, 0, 65535), 0).astype(np.uint16)


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending keys as differences in byte planes, and counts, compressed."""
    gaps = np.diff(keys, prepend=_U(0))
    kind = "<u1" if counts.max(initial=0) < 256 else "<u8"
    raw = gaps.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes() + counts.astype(kind).tobytes()
    return len(keys).to_bytes(8, "little") + kind.encode() + len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, kind, size = int.from_bytes(blob[:8], "little"), blob[8:11].decode(), int.from_bytes(blob[11:19], "little")
    raw = np.frombuffer(pa.Codec("zstd").decompress(blob[19:], size, asbytes=True), np.uint8)
    gaps = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view("<u8").ravel()
    return np.cumsum(gaps, dtype=np.uint64), raw[8 * n :].view(kind).astype(np.int64)


def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their counts."""
    keys = np.concatenate([k for k, _ in parts]) if parts else np.empty(0, np.uint64)
    counts = np.concatenate([c for _, c in parts]) if parts else np.empty(0, np.int64)
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts[order], first)


def shrink(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes, compressed."""
    raw = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() for a in arrays if len(a))
    head = ",".join(f"{a.dtype.str}:{len(a)}" for a in arrays).encode()
    return len(head).to_bytes(4, "little") + len(raw).to_bytes(8, "little") + head + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def grow(blob: bytes) -> list[np.ndarray]:
    """The arrays of shrink()."""
    n, size = int.from_bytes(blob[:4], "little"), int.from_bytes(blob[4:12], "little")
    raw = np.frombuffer(pa.Codec("zstd").decompress(blob[12 + n :], size, asbytes=True), np.uint8)
    out, at = [], 0
    for kind, count in (x.split(":") for x in blob[12 : 12 + n].decode().split(",")):
        width, count = np.dtype(kind).itemsize, int(count)
        planes = raw[at : at + width * count].reshape(width, count)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(count))
        at += width * count
    return out


def _gaps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=_U(0))


def _sums(gaps: np.ndarray) -> np.ndarray:
    return np.cumsum(gaps, dtype=np.uint64)


def _segments(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, start, end) of runs of equal values."""
    if not len(values):
        return
    cuts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1], [True])))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(values[a]), int(a), int(b)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, ascending; place of each key among them)."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    place = np.empty(len(keys), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[new], place


@dataclass(frozen=True)
class Spec:
    """What tasks get: where the files are and the totals; a few numbers a shard and a hot word.

    Shards 0 to shards - 1 hold the words of a range of hashes. Hot words, by ascending id, have parts[i] shards
    of their own from first[i] on.
    """

    path: str
    shards: int
    offsets: tuple[int, ...] = ()
    tokens: int = 0
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    hot_counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    parts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    kept: bool = False

    @property
    def words(self) -> int:
        return self.offsets[-1] if self.offsets else 0

    @property
    def first(self) -> np.ndarray:
        return self.shards + np.cumsum(self.parts) - self.parts

    def base(self, s: int) -> int:
        return -(-s * (1 << 32) // self.shards) << 32

    def file(self, level: str, s: int) -> str:
        return f"{self.path}/{level}-{s}"

    def shards_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The shard of each pair of ids."""
        out = np.searchsorted(np.array(self.offsets, dtype=np.int64), left, "right") - 1
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, left), len(self.hot) - 1)
            hot = np.flatnonzero(self.hot[at] == left)
            at = at[hot]
            part = ((tx.mix(right[hot].astype(np.uint64)) >> _U(32)) * self.parts[at].astype(np.uint64)) >> _U(32)
            out[hot] = self.first[at] + part.astype(np.int64)
        return out


class Words:
    """Lookups over the word files of a Spec; files open when first needed."""

    def __init__(self, spec: Spec):
        self.spec = spec
        self.open: dict[tuple[int, str], EliasFano] = {}

    def coded(self, s: int, name: str) -> EliasFano:
        if (s, "hash") not in self.open:
            arrays = map_arrays(self.spec.file("words", s))
            self.open[s, "hash"], self.open[s, "total"] = EliasFano(arrays, "hash."), EliasFano(arrays, "total.")
        return self.open[s, name]

    def shards(self, hashes: np.ndarray) -> np.ndarray:
        return (((hashes >> _U(32)) * _U(self.spec.shards)) >> _U(32)).astype(np.int64)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Word ids of ascending hashes; -1 where unknown."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        offsets = self.spec.offsets
        for s, a, b in _segments(self.shards(hashes)):
            if not self.spec.words or offsets[s + 1] == offsets[s]:
                continue
            at, ok = self.coded(s, "hash").find(hashes[a:b] - _U(self.spec.base(s)))
            out[a:b][ok] = at[ok] + offsets[s]
        return out

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Training counts of ascending ids."""
        out = np.zeros(len(ids), dtype=np.int64)
        for s, a, b in _segments(np.searchsorted(np.array(self.spec.offsets), ids, "right") - 1):
            total = self.coded(s, "total")
            at = ids[a:b] - self.spec.offsets[s]
            out[a:b] = total[at].astype(np.int64)
            later = at > 0
            out[a:b][later] -= total[at[later] - 1].astype(np.int64)
        return out


def level(contexts: np.ndarray, children: np.ndarray, codes: np.ndarray, n_contexts: int) -> dict[str, np.ndarray]:
    """Arrays of one level of a shard: n-grams by context, then child."""
    # children go on counting where the context before ended, so that each is relative to its context
    greatest = np.zeros(n_contexts, dtype=np.int64)
    last = np.flatnonzero(np.concatenate((contexts[1:] != contexts[:-1], [True]))) if len(contexts) else np.zeros(0, np.int64)
    greatest[contexts[last]] = children[last] + 1
    base = np.concatenate(([0], np.cumsum(greatest)))
    values = (children + 1 + base[contexts]).astype(np.uint64)
    return {**EliasFano.build(base, int(base[-1]) + 1, "base."), **EliasFano.build(values, int(base[-1]) + 1, "child."), "p": codes}


def find_children(arrays: dict[str, np.ndarray], contexts: np.ndarray, children: np.ndarray) -> np.ndarray:
    """Index of each child below its context in a level, -1 where there is none: successor search among the context's children."""
    out = np.full(len(contexts), -1, dtype=np.int64)
    if not len(arrays["p"]):
        return out
    bases, values = EliasFano(arrays, "base."), EliasFano(arrays, "child.")
    for k in range(0, len(contexts), CHUNK):
        # the children of a context are the values above its base, up to the next context's base
        base, after = bases.pair(contexts[k : k + CHUNK])
        want = base + children[k : k + CHUNK].astype(np.uint64) + _U(1)
        near = np.flatnonzero(want <= after)
        at, ok = values.find(want[near])
        out[k + near[ok]] = at[ok]
    return out


def _tokens(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, token hashes with an end after each row, first token of each row) of slices of (.., text)."""
    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        _, at = tx.buffers(column)
        lo = 0
        while lo < batch.num_rows:
            hi = min(batch.num_rows, max(lo + 1, int(np.searchsorted(at, at[lo] + size, side="right")) - 1))
            words, bounds, _, _ = tx.word_hashes(column.slice(lo, hi - lo))
            n = hi - lo
            first = bounds + np.arange(n + 1)
            out = np.empty(len(words) + n, dtype=np.uint64)
            is_end = np.zeros(len(out), dtype=bool)
            is_end[first[1:] - 1] = True
            out[is_end], out[~is_end] = END, words
            yield batch.slice(lo, n), out, first
            lo = hi


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def _learn_words(docs: DataFrame, model: str | None) -> Spec:
    """Counts the words of docs (text) and writes them to the shared folder."""
    spark = docs.sparkSession
    with run_once(spark):
        size = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    spec = Spec(model or new_path(spark, "lm"), max(1, -(-int(size) // SHARD_BYTES)))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        words = Words(spec)

        def flush() -> pa.RecordBatch:
            keys, counts = merge(held)
            cuts = list(_segments(words.shards(keys)))
            return pa.RecordBatch.from_arrays([pa.array([s for s, _, _ in cuts], pa.int32()), pa.array([pack(keys[a:b], counts[a:b]) for _, a, b in cuts], pa.binary())], ["shard", "blob"])

        for _, tokens, _ in _tokens(batches, SLICE_BYTES):
            held.append(np.unique(tokens, return_counts=True))
            if sum(len(k) for k, _ in held) > FLUSH_KEYS:
                yield flush()
                held.clear()
        if held:
            yield flush()

    def write_words(key: tuple, table: pa.Table) -> pa.Table:
        s = key[0].as_py()
        keys, counts = merge([unpack(b) for b in table["blob"].to_pylist()])
        total = np.cumsum(counts)
        width = spec.base(s + 1) - spec.base(s) if s + 1 < spec.shards else (1 << 64) - spec.base(s)
        write_arrays(spec.file("words", s), {**EliasFano.build(keys - _U(spec.base(s)), width, "hash."), **EliasFano.build(total.astype(np.uint64), int(total[-1]) + 1, "total.")})
        hot = np.flatnonzero(counts > HOT_TOKENS)
        return pa.table(
            {"shard": pa.array([s], pa.int32()), "n": pa.array([len(keys)], pa.int64()), "total": pa.array([int(total[-1])], pa.int64()), "hot": pa.array([hot.tolist()], pa.list_(pa.int64())), "counts": pa.array([counts[hot].tolist()], pa.list_(pa.int64()))}
        )

    with run_once(spark):
        done = docs.mapInArrow(count_words, "shard int, blob binary").groupBy("shard").applyInArrow(write_words, "shard int, n long, total long, hot array<long>, counts array<long>").collect()
    sizes = {r["shard"]: r for r in done}
    offsets = [0]
    for s in range(spec.shards):
        offsets.append(offsets[-1] + (sizes[s]["n"] if s in sizes else 0))
    if offsets[-1] >= NO_WORD:
        raise ValueError("more than 2^32 distinct words")
    # hot words have HOT_TOKENS tokens each: at most tokens / HOT_TOKENS of them come here
    hot = np.array([offsets[s] + w for s in sorted(sizes) for w in sizes[s]["hot"]], dtype=np.int64)
    counts = np.array([c for s in sorted(sizes) for c in sizes[s]["counts"]], dtype=np.int64)
    return Spec(spec.path, spec.shards, tuple(offsets), sum(r["total"] for r in done), hot, counts, -(-counts // HOT_TOKENS), model is not None)


def _write_slices(docs: DataFrame, spec: Spec) -> DataFrame:
    """(slice) of the slices that the rows of docs (doc_id, held_out, learn, text) were written as."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(spec)
        for rows, tokens, first in _tokens(batches, SLICE_BYTES):
            distinct, place = _distinct(tokens)
            ids = words.ids(distinct)
            known = ids >= 0
            ids = ids[known]
            counts = words.counts(ids)
            # an unknown word is number len(ids); tokens are written by the rank of their word, commonest first
            number = np.where(known, np.cumsum(known) - 1, len(ids))
            rank = np.empty(len(ids) + 1, dtype=np.uint32)
            rank[_commonest(counts)] = np.arange(len(ids) + 1)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema(list(rows.schema)[:3])) as out:
                out.write_batch(rows.select([0, 1, 2]))
            name = uuid.uuid4().hex
            write_arrays(
                f"{spec.path}/slice-{name}",
                {
                    "rows": np.frombuffer(sink.getvalue(), np.uint8),
                    "tokens": np.frombuffer(shrink(_gaps(ids.astype(np.uint64)), counts, np.diff(first), rank[number][place]), np.uint8),
                },
            )
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["slice"])

    return cut(docs.mapInArrow(run, "slice string"), "slices")


def _commonest(counts: np.ndarray) -> np.ndarray:
    """Numbers of words, commonest first; the number of unknown words last."""
    return np.append(np.argsort(-counts, kind="stable"), len(counts))


class Slice:
    """The tokens of a slice and its distinct pairs and triples, by shard.

    At each place with a known word before stands the pair of that word and the token, and the triple of
    these and the token after; what is unknown or beyond the end of the text has no word.
    """

    def __init__(self, spec: Spec, name: str):
        arrays = map_arrays(f"{spec.path}/slice-{name}")
        self.rows = pa.ipc.open_stream(pa.py_buffer(arrays["rows"])).read_next_batch()
        gaps, self.counts, sizes, ranks = grow(arrays["tokens"].tobytes())
        self.ids, self.first = _sums(gaps).astype(np.int64), np.concatenate(([0], np.cumsum(sizes)))
        self.tokens = _commonest(self.counts).astype(np.uint32)[ranks]
        del arrays, gaps, ranks
        none = len(self.ids)  # number of unknown words
        end = np.uint32(self.tokens[-1])
        self.before = np.empty_like(self.tokens)
        self.before[1:] = self.tokens[:-1]
        self.before[self.first[:-1]] = end
        after = np.full_like(self.tokens, none)
        after[:-1] = self.tokens[1:]
        after[self.first[1:] - 1] = none
        after[self.tokens == none] = none
        #: places with a pair, and which pair and triple it is
        self.at = np.flatnonzero(self.before != none)
        left = self.before[self.at].astype(np.uint64)
        pairs, self.pair = _distinct((left << _U(32)) | self.tokens[self.at])
        triples, self.triple = _distinct((self.pair.astype(np.uint64) << _U(32)) | after[self.at])
        ids = np.append(self.ids, NO_WORD)
        self.left = (pairs >> _U(32)).astype(np.int64)
        left_id, right_id = ids[self.left], ids[(pairs & _U(NO_WORD)).astype(np.int64)]
        self.context = (triples >> _U(32)).astype(np.int64)
        third = ids[(triples & _U(NO_WORD)).astype(np.int64)]
        shard = spec.shards_of(left_id, right_id)
        #: pairs and triples in order of shard, and where each shard's are
        self.by_shard = np.argsort(shard, kind="stable")
        of_triple = shard[self.context]
        self.triples_by_shard = np.argsort(of_triple, kind="stable")
        self.cuts = [(s, a, b) for s, a, b in _segments(shard[self.by_shard])]
        self.triple_cuts = {s: (a, b) for s, a, b in _segments(of_triple[self.triples_by_shard])}
        self.pair_keys = ((left_id.astype(np.uint64) << _U(32)) | right_id.astype(np.uint64))[self.by_shard]
        self.thirds = third[self.triples_by_shard]

    def requests(self, learn: np.ndarray, spec: Spec) -> Iterator[tuple[int, bytes]]:
        """(shard, pairs, triples and their counts in the rows to learn from)."""
        weight = np.repeat(learn, np.diff(self.first))[self.at]
        counts = np.bincount(self.triple, weight, len(self.context)).astype(np.int64)[self.triples_by_shard]
        place = np.empty(len(self.by_shard), dtype=np.int64)
        place[self.by_shard] = np.arange(len(self.by_shard))
        context = place[self.context[self.triples_by_shard]]
        small = np.uint8 if counts.max(initial=0) < 256 else np.uint32
        asked = set()
        for s, a, b in self.cuts:
            c, d = self.triple_cuts[s]
            keys = ((context[c:d] - a).astype(np.uint64) << _U(32)) | self.thirds[c:d].astype(np.uint64)
            asked.add(s)
            yield s, shrink(_gaps(self.pair_keys[a:b]), _gaps(keys), counts[c:d].astype(small))
        # the mass of a hot word's pairs is in all of its shards
        for s in self.hot_shards(spec) - asked:
            yield s, shrink(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint8))

    def hot_shards(self, spec: Spec) -> set[int]:
        return {int(f) + k for f, n, w in zip(spec.first, spec.parts, spec.hot, strict=True) if _has(self.ids, w) for k in range(n)}

    def scores(self, spec: Spec, answers: dict[int, list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability of each token by the model, by its count alone)."""
        pair_p, pair_rest = np.zeros(len(self.left), np.uint16), np.full(len(self.left), 65535, np.uint16)
        triple_p = np.zeros(len(self.context), np.uint16)
        left_rest = np.full(len(self.ids) + 1, 65535, np.uint16)
        left = self.left[self.by_shard]
        for s, a, b in self.cuts:
            where = self.by_shard[a:b]
            c, d = self.triple_cuts[s]
            p, rest, third_p, used = answers[s]
            pair_p[where], pair_rest[where], triple_p[self.triples_by_shard[c:d]] = p, rest, third_p
            if s < spec.shards:
                left_rest[_heads(left[a:b])] = used
        for f, n, w in zip(spec.first, spec.parts, spec.hot, strict=True):
            if _has(self.ids, w):
                left_rest[np.searchsorted(self.ids, w)] = _rest(np.array([sum(float(answers[int(f) + k][3][0]) for k in range(n))]))[0]
        alone = (np.append(self.counts, 0)[self.tokens] + 1) / (spec.tokens + spec.words + 1)
        p = alone.copy()
        p[self.at] *= _CODES[left_rest][self.before[self.at]]
        p[self.at] += _CODES[pair_p[self.pair]]
        # the pair before a token is its context; a row's first token has none
        starts = np.zeros(len(self.tokens) + 1, dtype=bool)
        starts[self.first] = True
        has = ~starts[self.at + 1]
        inside, context, third = self.at[has] + 1, self.pair[has], self.triple[has]
        p[inside] *= _CODES[pair_rest[context]]
        p[inside] += _CODES[triple_p[third]]
        return np.log10(p), np.log10(alone)


def _rest(mass: np.ndarray) -> np.ndarray:
    """Codes of what contexts leave to shorter ones."""
    return encode(np.maximum(0.0, 1.0 - mass))


def _has(ids: np.ndarray, word: int) -> bool:
    at = int(np.searchsorted(ids, word))
    return at < len(ids) and int(ids[at]) == int(word)


def _heads(values: np.ndarray) -> np.ndarray:
    """The distinct ones of ascending values."""
    return values[np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))] if len(values) else values


def _answer(spec: Spec, s: int, table: pa.Table) -> pa.Table:
    """Writes the levels of a shard and answers each slice: probabilities and rests of its pairs, probabilities of its triples; what its first words leave to shorter contexts, or for a hot word the mass that is here."""
    asked = [grow(b.as_py()) for b in table["blob"]]
    pair_keys = [_sums(a[0]) for a in asked]
    bounds = np.concatenate(([0], np.cumsum([len(k) for k in pair_keys])))
    pairs, pair = _distinct(np.concatenate(pair_keys))
    keys = np.concatenate([_sums(a[1]) for a in asked])
    counts = np.concatenate([a[2].astype(np.int64) for a in asked])
    sizes = [len(a[1]) for a in asked]
    del asked, pair_keys
    row = np.repeat(bounds[:-1], sizes)
    triples, triple = _distinct((pair[(keys >> _U(32)).astype(np.int64) + row].astype(np.uint64) << _U(32)) | (keys & _U(NO_WORD)))
    del keys, row
    times = np.bincount(triple, counts, len(triples)).astype(np.int64)
    del counts
    above = (triples >> _U(32)).astype(np.int64)
    pair_times = np.bincount(above, times, len(pairs)).astype(np.int64)
    left, right = (pairs >> _U(32)).astype(np.int64), (pairs & _U(NO_WORD)).astype(np.int64)

    # pairs that training has, below their first words
    if s < spec.shards:
        base, n = spec.offsets[s], spec.offsets[s + 1] - spec.offsets[s]
        seen = Words(spec).counts(np.arange(n, dtype=np.int64) + base)
    else:
        word = int(np.searchsorted(spec.first, s, "right")) - 1
        base, n, seen = int(spec.hot[word]), 1, spec.hot_counts[word : word + 1]
    kept = np.flatnonzero(pair_times)
    context = left[kept] - base
    codes = encode((pair_times[kept] - DISCOUNT) / seen[context])
    mass = np.bincount(context, _CODES[codes], n)
    # triples that training has, below their pairs
    index = np.full(len(pairs), -1, dtype=np.int64)
    index[kept] = np.arange(len(kept))
    third = (triples & _U(NO_WORD)).astype(np.int64)
    known = np.flatnonzero((times > 0) & (third != NO_WORD))
    parent = index[above[known]]
    third_codes = encode((times[known] - DISCOUNT) / pair_times[above[known]])
    rest = _rest(np.bincount(parent, _CODES[third_codes], len(kept)))
    # levels that go again are this attempt's own, so that another attempt at the task does not meet them
    own = "" if spec.kept else f"-{uuid.uuid4().hex}"
    write_arrays(spec.file("pairs", s) + own, {**level(context, right[kept], codes, n), "rest": rest})
    write_arrays(spec.file("triples", s) + own, level(parent, third[known], third_codes, len(kept)))
    del context, codes, parent, third_codes, times, pair_times, known

    arrays = map_arrays(spec.file("pairs", s) + own)
    at = find_children(arrays, left - base, right)
    hit = at >= 0
    pair_p, pair_rest = np.zeros(len(pairs), np.uint16), np.full(len(pairs), 65535, np.uint16)
    pair_p[hit], pair_rest[hit] = arrays["p"][at[hit]], arrays["rest"][at[hit]]
    arrays = map_arrays(spec.file("triples", s) + own)
    open_ = np.flatnonzero((at[above] >= 0) & (third != NO_WORD))
    found = find_children(arrays, at[above[open_]], third[open_])
    triple_p = np.zeros(len(triples), np.uint16)
    triple_p[open_[found >= 0]] = arrays["p"][found[found >= 0]]

    if not spec.kept:
        for name in ("pairs", "triples"):
            drop_file(spec.file(name, s) + own)
    blobs, begun = [], 0
    for k, size in enumerate(sizes):
        mine, its = pair[bounds[k] : bounds[k + 1]], triple[begun : begun + size]
        begun += size
        used = mass if s >= spec.shards else _rest(mass)[_heads(left[mine]) - base]
        blobs.append(shrink(pair_p[mine], pair_rest[mine], triple_p[its], used))
    return pa.table({"slice": table["slice"], "shard": pa.array([s] * len(blobs), pa.int32()), "blob": pa.array(blobs, pa.binary())})


def lm_scores(docs: DataFrame, learn: Column | None = None, model: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from the rows for which learn is true; by default from those outside the held-out fold.
    Its levels stay in the folder model if one is named, once the result has been read; else each goes when
    its shard has answered.

    Tokens are words and one end a text, so that null and empty texts have one token. A null doc_id is in
    training by default. Repeated rows count and score each; an empty table gives none; without training rows
    every score is 0. Other columns are not read. A task holds one text whole, however long.
    """
    held_out = is_held_out(F.col("doc_id"))
    learn = ~held_out if learn is None else F.coalesce(learn, F.lit(False))
    rows = docs.select("doc_id", held_out.alias("held_out"), learn.alias("learn"), "text")
    spec = _learn_words(rows.where("learn").select("text"), model)
    slices = _write_slices(rows, spec)
    tasks = -(-slices.count() // 2)
    asked = "shard int, slice string, blob binary"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                part = Slice(spec, name)
                found = list(part.requests(part.rows.column(2).to_numpy(zero_copy_only=False), spec))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.int32()), pa.array([name] * len(found)), pa.array([b for _, b in found], pa.binary())], ["shard", "slice", "blob"])

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        return _answer(spec, key[0].as_py(), table)

    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(key: tuple, table: pa.Table) -> pa.Table:
        part = Slice(spec, key[0].as_py())
        answers = {s: grow(b) for s, b in zip(table["shard"].to_pylist(), table["blob"].to_pylist(), strict=True) if s >= 0}
        model, alone = part.scores(spec, answers)
        starts, known = part.first[:-1], part.tokens != len(part.ids)
        return pa.table(
            {
                "doc_id": part.rows.column(0), "held_out": part.rows.column(1), "n_tokens": pa.array(np.diff(part.first), pa.int64()), "n_known": pa.array(np.add.reduceat(known.astype(np.int64), starts)),
                "train_tokens": pa.array(np.full(len(starts), spec.tokens), pa.int64()), "base_score": pa.array(np.add.reduceat(alone, starts)), "score": pa.array(np.add.reduceat(model, starts)),
            }
        )

    answers = slices.repartition(max(1, tasks)).mapInArrow(ask, asked).groupBy("shard").applyInArrow(answer, "slice string, shard int, blob binary")
    # every slice comes, also one that asked for nothing
    every = answers.unionByName(slices.select("slice", F.lit(-1).alias("shard"), F.lit(None).cast("binary").alias("blob")))
    return every.groupBy("slice").applyInArrow(score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
