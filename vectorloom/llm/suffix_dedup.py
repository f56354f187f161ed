"""Exact removal of repeated substrings by blockwise sorting around a cover sample.

Every string of ``WIDTH`` bytes holds the place where its smallest GRAM-byte hash stands, at the same
offset wherever the string occurs. These places are the cover sample: content-defined instead of modular
like a difference cover, so that of all starts only about 3 % are sampled and need to be moved. Starts
that share a sample place follow one another and go together as one stretch.

1. Sampled grams are counted; a bit filter of those that occur twice goes to the shared folder.
2. Stretches at repeated grams are dealt into buckets by gram; those at grams that very many texts have are
   halved and dealt by grams grown to one side, so that no gram's bucket holds all of them. Equal stretches
   are ties of any length that need no sorting; only the first of each is kept.
3. A task sorts one bucket at a time, piece by piece of whole grams: the sample places of a piece get their
   ranks in suffix order (bytes from the place on) and in prefix order (bytes before it, backwards), with
   the lengths that neighbours share. Two starts at one offset from their sample place hold equal strings
   if no shorter shared length stands between their ranks on either side, so that these ranks resolve all
   ties without looking at the strings again. All but the first of equal starts are reported.
4. Reported spans are merged by document and written as files; a last pass over the texts cuts them out.

Hashes only choose sample places and buckets; whatever is reported was compared byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm import text as tx
from vectorloom.llm.elias_fano import map_arrays, write_arrays
from vectorloom.llm.ngram_lm import merge, pack, unpack
from vectorloom.llm.shared import new_path

WIDTH, GRAM = 100, 32
_STARTS = WIDTH - GRAM + 1
_U = np.uint64
_BLOCK = 1 << 16
_PLACE = _U((1 << 17) - 1)
#: Text bytes that one bucket is made of.
BUCKET_BYTES = 8 << 20
#: Stretches that a bucket sorts at once, as far as grams can be told apart.
SORT_STRETCHES = 30_000
#: Stretches that a task gathers before it deals them out, and sampled grams before it sends their counts.
FLUSH_ROWS, FLUSH_GRAMS = 100_000, 1_500_000
#: Stretches at a gram that occurs more often than this are halved and dealt by longer grams.
HOT = 4096
#: Bytes by which a gram grows, to either side; windows have so many before or after it.
_GROWN = (WIDTH - GRAM) // 2
NULL_ID = np.iinfo(np.int64).max

_BYTE = tx.mix(np.arange(1, 257, dtype=np.uint64) * _U(0xA0761D6478BD642F))
_BYTE2 = tx.mix(np.arange(1, 257, dtype=np.uint64) * _U(0xE7037ED1A0B428DB))
_SPREAD, _LEFT, _RIGHT = _U(0x8EBC6AF09C88C6E3), _U(0x589965CC75374CC3), _U(0x1D8E4E27C47D124F)


def _prefix(block: np.ndarray, table: np.ndarray) -> np.ndarray:
    up, _ = tx._tables_for(len(block))
    out = np.empty(len(block) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(np.take(table, block, mode="clip") * up[: len(block)], out=out[1:])
    return out


def _hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = tx._tables_for(len(prefix))
    return (prefix[end] - prefix[start]) * down[start]


def stretches(raw: np.ndarray, at: np.ndarray, look: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """(gram, name, start, count, bytes before the sample place) of the stretches of a block, for texts raw at offsets at.

    look tells for grams which stretches are wanted and which of them are halved; without it all come whole.
    """
    n = len(raw)
    for lo in range(0, n, _BLOCK):
        block = raw[lo : lo + _BLOCK + WIDTH - 1]
        m = len(block)
        starts = m - WIDTH + 1
        if starts <= 0:
            continue
        prefix = _prefix(block, _BYTE)
        places = np.arange(m - GRAM + 1)
        gram = tx.mix(_hash(prefix, places, places + GRAM))
        key = (gram & ~_PLACE) | places.astype(np.uint64)
        # the least key among the _STARTS places of each start
        padded = np.full(-(-len(key) // _STARTS) * _STARTS, ~_U(0))
        padded[: len(key)] = key
        rows = padded.reshape(-1, _STARTS)
        fore = np.minimum.accumulate(rows, axis=1).ravel()
        back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        place = (np.minimum(back[:starts], fore[_STARTS - 1 : _STARTS - 1 + starts]) & _PLACE).astype(np.int64)
        # starts too near the end of their text
        bad = np.zeros(starts + 1, dtype=np.int32)
        ends = at[np.searchsorted(at, lo, "right") : np.searchsorted(at, lo + m, "right")] - lo
        np.add.at(bad, np.clip(ends - WIDTH + 1, 0, starts), 1)
        np.add.at(bad, np.clip(ends, 0, starts), -1)
        good = np.cumsum(bad[:-1]) == 0
        turn = np.ones(starts + 1, dtype=bool)
        turn[1:-1] = (place[1:] != place[:-1]) | (good[1:] != good[:-1])
        cuts = np.flatnonzero(turn)
        first, count = cuts[:-1], np.diff(cuts)
        ok = good[first]
        first, count = first[ok], count[ok]
        place = place[first]
        # sampled grams are small numbers: mixed again they are spread evenly
        found = tx.mix(gram[place] ^ _SPREAD)
        if look is not None and len(first):
            wanted, hot = look(found)
            first, count, place, found, hot = first[wanted], count[wanted], place[wanted], found[wanted], hot[wanted]
            if hot.any():
                first, count, place, found = _halved(prefix, first, count, place, found, hot)
        if not len(first):
            continue
        before = place - first
        name = tx.mix(_hash(prefix, first, first + count + WIDTH - 1) ^ tx.mix((count.astype(np.uint64) << _U(32)) | before.astype(np.uint64)))
        yield found, name, first + lo, count, before


def _halved(prefix: np.ndarray, first: np.ndarray, count: np.ndarray, place: np.ndarray, gram: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """The stretches, hot ones cut in two: starts with _GROWN bytes before the gram, and the others, which have them after it."""
    ahead = np.where(hot, np.clip(place - first - _GROWN + 1, 0, count), 0)
    left, right = np.flatnonzero(hot & (ahead > 0)), np.flatnonzero(hot & (ahead < count))
    grown_left = tx.mix(_hash(prefix, place[left] - _GROWN, place[left] + GRAM) ^ _LEFT)
    grown_right = tx.mix(_hash(prefix, place[right], place[right] + GRAM + _GROWN) ^ _RIGHT)
    plain = np.flatnonzero(~hot)
    out = (
        np.concatenate((first[plain], first[left], first[right] + ahead[right])),
        np.concatenate((count[plain], ahead[left], count[right] - ahead[right])),
        np.concatenate((place[plain], place[left], place[right])),
        np.concatenate((gram[plain], grown_left, grown_right)),
    )
    order = np.argsort(out[0], kind="stable")
    return tuple(x[order] for x in out)


def _second_names(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """An independent hash of the bytes of each stretch; starts ascend."""
    out = np.empty(len(start), dtype=np.uint64)
    i = 0
    while i < len(start):
        lo = int(start[i])
        j = int(np.searchsorted(start, lo + _BLOCK, "left"))
        hi = int((start[i:j] + size[i:j]).max())
        prefix = _prefix(raw[lo:hi], _BYTE2)
        out[i:j] = tx.mix(_hash(prefix, start[i:j] - lo, start[i:j] + size[i:j] - lo))
        i = j
    return out


def _gather(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all ranges one after another, offsets)."""
    offsets = np.zeros(len(start) + 1, dtype=np.int64)
    np.cumsum(size, out=offsets[1:])
    return raw[np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)], offsets


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, ids, hashes of the texts) of slices of (doc_id, text) batches."""
    for batch in batches:
        raw, at = tx.buffers(batch.column(1))
        ids = batch.column(0).fill_null(NULL_ID).to_numpy()
        lo = 0
        while lo < len(ids):
            hi = min(len(ids), max(lo + 1, int(np.searchsorted(at, at[lo] + (4 << 20), side="right")) - 1))
            part, offsets = raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
            view = memoryview(part)
            names = np.fromiter((xxhash.xxh64_intdigest(view[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)), np.uint64, hi - lo)
            yield part, offsets, ids[lo:hi], names
            lo = hi


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (((hashes >> _U(32)) * _U(buckets)) >> _U(32)).astype(np.int64)


def _bit(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    slot = tx.mix(hashes) & _U(bits - 1)
    return (slot >> _U(3)).astype(np.int64), (slot & _U(7)).astype(np.uint8)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Starts of runs of equal rows, and the length."""
    n = len(columns[0])
    turn = np.ones(n + 1, dtype=bool)
    turn[1:-1] = False
    for c in columns:
        turn[1:-1] |= c[1:] != c[:-1]
    return np.flatnonzero(turn)


def _blob(columns: dict[str, np.ndarray], binary: tuple[np.ndarray, np.ndarray] | None = None) -> bytes:
    arrays = {k: pa.array(v) for k, v in columns.items()}
    if binary is not None:
        data, offsets = binary
        arrays["bytes"] = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
    table = pa.table(arrays)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _tables(blobs: pa.ChunkedArray) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(b.as_buffer()).read_all() for b in blobs]).combine_chunks()


def _rows(keys: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])


def _by_document(doc: np.ndarray, name: np.ndarray, start: np.ndarray, end: np.ndarray, parts: int) -> list[tuple[int, bytes]]:
    """Spans, merged as far as they touch, as one blob for each part of the documents."""
    if not len(doc):
        return []
    order = np.lexsort((start, name, doc))
    doc, name, start, end = _union(doc[order], name[order], start[order], end[order])
    where = _bucket(tx.mix(doc.view(np.uint64)), parts)
    out = []
    for p in np.unique(where):
        at = where == p
        out.append((int(p), _blob({"doc": doc[at], "name": name[at], "start": start[at], "end": end[at]})))
    return out


def _union(doc: np.ndarray, name: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Maximal spans of spans sorted by document and start."""
    cuts = _runs(doc, name)[:-1]
    owner = np.zeros(len(doc), dtype=np.int64)
    owner[cuts[1:]] = 1
    owner = np.cumsum(owner)
    # running greatest end within a document: shift documents apart
    wide = int(end.max()) + 1 if len(end) else 1
    reach = np.maximum.accumulate(end + owner * wide) - owner * wide
    fresh = np.ones(len(doc), dtype=bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (start[1:] > reach[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], name[first], start[first], reach[last]


def _same_bytes(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ranges of size bytes that begin at a and at b are equal."""
    out = np.empty(len(a), dtype=bool)
    step = 16384
    for k in range(0, len(a), step):
        x, offsets = _gather(raw, a[k : k + step], size[k : k + step])
        y, _ = _gather(raw, b[k : k + step], size[k : k + step])
        out[k : k + step] = np.logical_and.reduceat(x == y, offsets[:-1]) if len(x) else True
    return out


def _equal_stretches(c: dict[str, np.ndarray], raw: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, head): stretches by content, the earliest of equal ones first, and the first one of each.

    Names find what may be equal, bytes decide: one whose bytes differ from the first of its name gets another name.
    """
    while True:
        order = np.lexsort((c["start"], c["text"], c["doc"], c["name2"], c["name1"]))
        cuts = _runs(c["name1"][order], c["name2"][order])
        head = np.empty(len(order), dtype=np.int64)
        head[order] = np.repeat(order[cuts[:-1]], np.diff(cuts))
        later = np.flatnonzero(head != np.arange(len(order)))
        first = head[later]
        same = (c["count"][later] == c["count"][first]) & (c["before"][later] == c["before"][first])
        same[same] = _same_bytes(raw, begin[later[same]], begin[first[same]], c["count"][later[same]] + WIDTH - 1)
        if same.all():
            return order, head
        c["name2"] = c["name2"].copy()
        c["name2"][later[~same]] += _U(1)


def _elsewhere(c: dict[str, np.ndarray], head: np.ndarray) -> np.ndarray:
    """Stretches that are not the first with their bytes; one that stands twice because its row is repeated is no other."""
    return (c["doc"] != c["doc"][head]) | (c["text"] != c["text"][head]) | (c["start"] != c["start"][head])


def _repeats(table: pa.Table, at_once: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, name of text, start, end) of the repeated spans of one bucket, about at_once stretches at a time."""
    c = {k: table[k].combine_chunks().to_numpy() for k in table.column_names if k != "bytes"}
    data = table["bytes"].combine_chunks()
    _, offsets, raw = data.buffers()
    begin = np.frombuffer(offsets, np.int64)[data.offset : data.offset + len(data)]
    raw = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    order, head = _equal_stretches(c, raw, begin)
    later = _elsewhere(c, head)
    found = [(c["doc"][later], c["text"][later], c["start"][later], c["start"][later] + c["count"][later] + WIDTH - 1)]
    keep = order[head[order] == order]
    # grams that several different stretches have
    keep = keep[np.argsort(c["gram"][keep], kind="stable")]
    sizes = np.diff(_runs(c["gram"][keep])) if len(keep) else np.empty(0, np.int64)
    keep = keep[np.repeat(sizes > 1, sizes)]
    groups = _runs(c["gram"][keep]) if len(keep) else np.zeros(1, np.int64)
    i = 0
    while i < len(groups) - 1:
        j = max(i + 1, int(np.searchsorted(groups, groups[i] + at_once, "right")) - 1)
        piece = keep[groups[i] : groups[j]]
        found.append(_repeated_starts({k: v[piece] for k, v in c.items()}, raw, begin[piece]))
        i = j
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


#: Bytes on either side of a gram that a window can reach, as whole words.
_SIDE = -(-(WIDTH - GRAM) // 8) * 8


def _ranked(side: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each row among the bytes of its side, by group first; length shared by rank r and the one before, -1 across groups)."""
    order = np.lexsort((*side.view(">u8").astype(np.uint64).T[::-1], group))
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    shared = np.full(len(order), -1, dtype=np.int64)
    step = 16384
    for k in range(1, len(order), step):
        a, b = order[k - 1 : min(k + step, len(order)) - 1], order[k : k + step]
        unlike = side[a] != side[b]
        length = np.where(unlike.any(1), unlike.argmax(1), _SIDE)
        shared[k : k + step] = np.where(group[a] == group[b], length, -1)
    return rank, shared


def _repeated_starts(c: dict[str, np.ndarray], raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of the starts of these stretches, whole grams, that are not the first with their bytes."""
    # in order of document and place, so that the first of equal ones comes first at every offset
    order = np.lexsort((c["start"] + c["before"], c["text"], c["doc"]))
    c, at = {k: v[order] for k, v in c.items()}, at[order]
    place, end = at + c["before"], at + c["count"] + WIDTH - 1
    # grams are told apart by their bytes too
    words = raw[place[:, None] + np.arange(GRAM)].view("<u8")
    by_gram = np.lexsort((*words.T, c["gram"]))
    turns = np.concatenate(([False], (c["gram"][by_gram][1:] != c["gram"][by_gram][:-1]) | (words[by_gram][1:] != words[by_gram][:-1]).any(1)))
    group = np.empty(len(order), dtype=np.int64)
    group[by_gram] = np.cumsum(turns)
    # bytes beyond a stretch's own count as 0: no window of it reaches them
    reach = np.arange(_SIDE)
    where = place[:, None] + GRAM + reach
    right_rank, right_shared = _ranked(np.where(where < end[:, None], raw[np.minimum(where, len(raw) - 1)], 0).astype(np.uint8), group)
    where = place[:, None] - 1 - reach
    left_rank, left_shared = _ranked(np.where(where >= at[:, None], raw[np.maximum(where, 0)], 0).astype(np.uint8), group)
    found = []
    for before in range(_STARTS):
        has = np.flatnonzero((c["before"] >= before) & (c["before"] - c["count"] < before))
        if len(has) < 2:
            continue
        left = np.cumsum(left_shared < before)[left_rank[has]]
        right = np.cumsum(right_shared < WIDTH - GRAM - before)[right_rank[has]]
        both = left * (len(order) + 1) + right
        by_string = np.argsort(both, kind="stable")
        cuts = _runs(both[by_string])
        head = np.repeat(has[by_string[cuts[:-1]]], np.diff(cuts))
        who = has[by_string]
        doc, text, start = c["doc"][who], c["text"][who], c["start"][who] + c["before"][who] - before
        # one occurrence may come twice, from repeated rows
        later = (doc != c["doc"][head]) | (text != c["text"][head]) | (start != c["start"][head] + c["before"][head] - before)
        found.append((doc[later], text[later], start[later]))
    if not found:
        none = np.empty(0, np.int64)
        return none, np.empty(0, np.uint64), none, none
    doc, text, start = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((start, text, doc))
    return _union(doc[order], text[order], start[order], start[order] + WIDTH) if len(order) else (doc, text, start, start)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Bytes go that a WIDTH-byte string covers which also starts earlier: in a smaller doc_id, or before in
    the same text. A null text is empty. A null doc_id comes after all others; texts under one doc_id are
    ordered by a hash of theirs; rows with equal doc_id and text are one document and get the same result.
    An empty table gives none; other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    buckets = max(1, -(-int(size) // BUCKET_BYTES))
    path = new_path(spark, "repeats")
    blobs = "part int, blob binary"

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            keys, counts = merge(held)
            where = _bucket(keys, buckets)
            cuts = _runs(where)
            return _rows([int(where[a]) for a in cuts[:-1]], [pack(keys[a:b], counts[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])

        for raw, at, _, _ in _texts(batches):
            grams = [s[0] for s in stretches(raw, at)]
            if grams:
                held.append(np.unique(np.concatenate(grams), return_counts=True))
            if sum(len(k) for k, _ in held) > FLUSH_GRAMS:
                yield flush()
                held = []
        if held:
            yield flush()

    def write_filter(key: tuple, table: pa.Table) -> pa.Table:
        keys, counts = merge([unpack(b) for b in table["blob"].to_pylist()])
        hot = keys[counts > HOT]
        keys = keys[counts > 1]
        bits = max(64, 1 << int(len(keys) * 12).bit_length())
        table_ = np.zeros(bits // 8, dtype=np.uint8)
        byte, bit = _bit(keys, bits)
        np.bitwise_or.at(table_, byte, np.uint8(1) << bit)
        write_arrays(f"{path}/grams-{key[0].as_py()}", {"bits": table_, "hot": hot})
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32())})

    docs.mapInArrow(count_grams, blobs).groupBy("part").applyInArrow(write_filter, "part int").collect()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: dict[int, dict[str, np.ndarray]] = {}  # opened when first needed
        held: list[dict[str, np.ndarray]] = []
        data: list[tuple[np.ndarray, np.ndarray]] = []

        def look(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """(which grams may occur again, which are hot)."""
            wanted, hot = np.zeros(len(gram), dtype=bool), np.zeros(len(gram), dtype=bool)
            where = _bucket(gram, buckets)
            order = np.argsort(where, kind="stable")
            cuts = _runs(where[order])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                mine = order[a:b]
                p = int(where[mine[0]])
                if p not in filters:
                    filters[p] = map_arrays(f"{path}/grams-{p}")
                byte, bit = _bit(gram[mine], len(filters[p]["bits"]) * 8)
                wanted[mine] = (filters[p]["bits"][byte] >> bit) & 1
                known = filters[p]["hot"]
                if len(known):
                    hot[mine] = known[np.minimum(np.searchsorted(known, gram[mine]), len(known) - 1)] == gram[mine]
            return wanted, hot

        def flush() -> Iterator[pa.RecordBatch]:
            """Of equal stretches the first is sent to its bucket, the others are reported."""
            c = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
            raw = np.concatenate([d for d, _ in data])
            sizes = np.concatenate([np.diff(o) for _, o in data])
            begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            order, head = _equal_stretches(c, raw, begin)
            later = _elsewhere(c, head)
            spans = _by_document(c["doc"][later], c["text"][later], c["start"][later], c["start"][later] + c["count"][later] + WIDTH - 1, buckets)
            if spans:
                yield _rows([-1 - p for p, _ in spans], [b for _, b in spans])
            keep = order[head[order] == order]
            where = _bucket(c["gram"][keep], buckets)
            by = np.argsort(where, kind="stable")
            keep, where = keep[by], where[by]
            cuts = _runs(where)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                at = keep[a:b]
                yield _rows([int(where[a])], [_blob({k: v[at] for k, v in c.items()}, _gather(raw, begin[at], sizes[at]))])

        gathered = 0
        for raw, at, ids, names in _texts(batches):
            for gram, name, start, count, before in stretches(raw, at, look):
                size_ = count + WIDTH - 1
                row = np.searchsorted(at, start, "right") - 1
                held.append(
                    {"gram": gram, "name1": name, "name2": _second_names(raw, start, size_), "doc": ids[row], "text": names[row], "start": start - at[row], "count": count, "before": before}
                )
                data.append(_gather(raw, start, size_))
                gathered += len(gram)
            if gathered > FLUSH_ROWS:
                yield from flush()
                held.clear()
                data.clear()
                gathered = 0
        if held:
            yield from flush()

    def sort_bucket(key: tuple, table: pa.Table) -> pa.Table:
        p = key[0].as_py()
        if p < 0:  # spans that are known already
            return pa.table({"part": pa.array([-1 - p] * table.num_rows, pa.int32()), "blob": table["blob"]})
        spans = _by_document(*_repeats(_tables(table["blob"]), SORT_STRETCHES), buckets)
        return pa.table({"part": pa.array([q for q, _ in spans], pa.int32()), "blob": pa.array([b for _, b in spans], pa.binary())})

    def write_spans(key: tuple, table: pa.Table) -> pa.Table:
        spans = _tables(table["blob"])
        c = [spans[k].to_numpy() for k in ("doc", "name", "start", "end")]
        order = np.lexsort((c[2], c[1], c[0]))
        doc, name, start, end = _union(*(x[order] for x in c))
        write_arrays(f"{path}/spans-{key[0].as_py()}", {"doc": doc, "name": name, "start": start, "end": end})
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32())})

    spans = docs.mapInArrow(deal, blobs).groupBy("part").applyInArrow(sort_bucket, blobs)
    wrote = {r["part"] for r in spans.groupBy("part").applyInArrow(write_spans, "part int").collect()}

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict[int, dict[str, np.ndarray]] = {}
        for raw, at, ids, names in _texts(batches):
            where = _bucket(tx.mix(ids.view(np.uint64)), buckets)
            removed, count, digest = [], [], []
            for i, doc_id in enumerate(ids):
                text = raw[at[i] : at[i + 1]]
                pieces: list[tuple[int, int]] = []
                part = int(where[i])
                if part in wrote:
                    if part not in files:
                        files[part] = map_arrays(f"{path}/spans-{part}")
                    f = files[part]
                    a, b = np.searchsorted(f["doc"], doc_id, "left"), np.searchsorted(f["doc"], doc_id, "right")
                    mine = np.flatnonzero(f["name"][a:b] == names[i]) + a
                    pieces = list(zip(f["start"][mine].tolist(), f["end"][mine].tolist(), strict=True))
                h, done = hashlib.sha256(), 0
                for s, e in pieces:
                    h.update(text[done:s])
                    done = e
                h.update(text[done:])
                removed.append(sum(e - s for s, e in pieces))
                count.append(len(pieces))
                digest.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=ids == NULL_ID), pa.array(np.diff(at), pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return docs.mapInArrow(cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
