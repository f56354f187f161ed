"""Benchmark decontamination by greedy string tiling.

Documents that share seeds (runs of ``least`` words) with a benchmark item are tiled: the longest
common runs of unmarked words, found by running Karp-Rabin hashes over halving lengths, are marked
one after another. An item whose words are covered by tiles to at least ``coverage`` is contained,
in whatever order its passages stand.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm import text as tx
from vectorloom.llm.elias_fano import map_arrays, write_arrays
from vectorloom.llm.shared import new_path, run_once

LEAST, COVERAGE = 4, 0.6
#: Bytes of benchmark text that a task holds at once; a larger benchmark is gone through in blocks.
BLOCK_BYTES = 16 << 20

#: ASCII punctuation separates words here; letters, digits and all non-ASCII bytes make them.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = 32


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, at = tx.buffers(texts)
    words, bounds, _, _ = tx.word_hashes_of(np.take(_PLAIN, raw, mode="clip"), at)
    return words, bounds


_MASK = (1 << 64) - 1
_PRIME = 0x100000001B3


def tiles(item: list[int], doc: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two word sequences: (start in item, start in doc, length) of each tile."""
    found: list[tuple[int, int, int]] = []
    item_free, doc_free = [True] * len(item), [True] * len(doc)

    def windows(words: list[int], free: list[bool], size: int) -> Iterator[tuple[int, int]]:
        """(start, running Karp-Rabin hash) of the windows without marked words."""
        top = pow(_PRIME, size - 1, 1 << 64)
        value = length = 0
        for i, word in enumerate(words):
            if not free[i]:
                value = length = 0
                continue
            if length == size:
                value = (value - words[i - size] * top) & _MASK
                length -= 1
            value = (value * _PRIME + word) & _MASK
            length += 1
            if length == size:
                yield i - size + 1, value

    size = max(least, min(len(item), len(doc)) // 2)
    while size >= least:
        starts: dict[int, list[int]] = {}
        for i, value in windows(item, item_free, size):
            starts.setdefault(value, []).append(i)
        matches: list[tuple[int, int, int]] = []
        for j, value in windows(doc, doc_free, size) if starts else ():
            for i in starts.get(value, ()):
                # runs are taken from where they begin only
                if i and j and item_free[i - 1] and doc_free[j - 1] and item[i - 1] == doc[j - 1]:
                    continue
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and item_free[i + n] and doc_free[j + n]:
                    n += 1
                if n >= size:
                    matches.append((-n, i, j))
        heapq.heapify(matches)
        while matches:
            n, i, j = heapq.heappop(matches)
            free = [item_free[i + k] and doc_free[j + k] for k in range(-n)]
            if all(free):
                found.append((i, j, -n))
                item_free[i : i - n] = [False] * -n
                doc_free[j : j - n] = [False] * -n
                continue
            # what is left of a part-marked run waits for its turn by length
            start = None
            for k, ok in enumerate([*free, False]):
                if ok and start is None:
                    start = k
                elif not ok and start is not None:
                    if k - start >= size:
                        heapq.heappush(matches, (start - k, i + start, j + start))
                    start = None
        size = size // 2 if size > 2 * least else (least if size > least else 0)
    return found


class Index:
    """Seeds of benchmark items: every run of ``least`` words, with its items and places."""

    def __init__(self, ids: pa.Array, texts: pa.Array, least: int = LEAST):
        words, bounds = words_of(texts)
        self.least = least
        sizes = np.diff(bounds)
        self.items = [words[bounds[i] : bounds[i + 1]].tolist() for i in range(len(ids))]
        self.ids = ids
        seeds, first = tx.all_shingles(words, bounds, least)
        owner = np.repeat(np.arange(len(ids)), np.diff(first))
        place = np.arange(len(seeds)) - first[owner] if len(seeds) else np.zeros(0, int)
        whole = sizes[owner] >= least
        seeds, owner, place = seeds[whole], owner[whole], place[whole]
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.owner, self.place = seeds[order], owner[order], place[order]
        self.bits = max(16, int(len(seeds) * 16).bit_length())
        self.filter = np.zeros(1 << self.bits, dtype=bool)
        self.filter[self._slots(self.seeds)] = True
        # items too short for a seed are looked for as a whole: by their number of words, hashes and items
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in range(1, least):
            mine = np.flatnonzero(sizes == n)
            if len(mine):
                whole_items = np.array([tx.shingles(words[bounds[i] : bounds[i + 1]], n)[0] for i in mine], dtype=np.uint64)
                order = np.argsort(whole_items, kind="stable")
                self.short[n] = whole_items[order], mine[order]

    def _short_ones(self, words: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item, words, 1, words) of the items too short for a seed whose words stand in a row in a text."""
        out = []
        for n, (hashes, items) in self.short.items():
            grams, first = tx.all_shingles(words, bounds, n)
            at = np.flatnonzero(hashes[np.minimum(np.searchsorted(hashes, grams), len(hashes) - 1)] == grams)
            rows = np.searchsorted(first, at, "right") - 1
            fits = np.diff(bounds)[rows] >= n  # fewer words than n make a gram of their own
            # of a gram that a text has many times one place is enough
            found = np.unique(np.stack((rows[fits].astype(np.uint64), grams[at[fits]])), axis=1)
            for row, gram in found.T:
                a, b = np.searchsorted(hashes, gram, "left"), np.searchsorted(hashes, gram, "right")
                out += [(int(row), int(items[k]), n, 1, n) for k in range(a, b)]
        return out

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, texts: pa.Array, coverage: float) -> list[tuple[int, int, int, int, int]]:
        """(row, item, words covered, tiles, longest tile) of every contained item."""
        words, bounds = words_of(texts)
        grams, first = tx.all_shingles(words, bounds, self.least)
        maybe = np.flatnonzero(self.filter[self._slots(grams)]) if len(grams) else np.zeros(0, int)
        lo = np.searchsorted(self.seeds, grams[maybe], "left")
        hi = np.searchsorted(self.seeds, grams[maybe], "right")
        hit = hi > lo
        maybe, lo, hi = maybe[hit], lo[hit], hi[hit]
        rows = np.searchsorted(first, maybe, "right") - 1
        out = []
        for a, b in _runs(rows):
            row = int(rows[a])
            at = maybe[a:b] - first[row]
            counts = hi[a:b] - lo[a:b]
            slot = np.repeat(lo[a:b] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
            item, place, where = self.owner[slot], self.place[slot], np.repeat(at, counts)
            order = np.lexsort((where, item))
            item, place, where = item[order], place[order], where[order]
            for c, d in _runs(item):
                size = len(self.items[item[c]])
                covered = np.zeros(size, dtype=bool)
                for k in range(self.least):
                    covered[place[c:d] + k] = True
                # tiles are made of seeds: they cannot cover more than these
                if covered.sum() < coverage * size:
                    continue
                # only the stretches of the text with seeds are tiled; 0 stands between them
                near = np.unique(where[c:d])
                doc: list[int] = []
                mine = words[bounds[row] : bounds[row + 1]]
                for e, f in _stretches(near, self.least):
                    doc += [*mine[e:f].tolist(), 0]
                made = tiles(self.items[item[c]], doc, self.least)
                matched = sum(n for _, _, n in made)
                if matched >= coverage * size:
                    out.append((row, int(item[c]), matched, len(made), max(n for _, _, n in made)))
        return out + self._short_ones(words, bounds) if self.short else out


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1], [True]))) if len(values) else []
    return zip(cuts[:-1], cuts[1:], strict=True) if len(values) else iter(())


def _stretches(starts: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    """Ranges of words that the runs of n words beginning at starts cover."""
    cut = np.flatnonzero(np.diff(starts) > n) + 1
    for part in np.split(starts, cut):
        yield int(part[0]), int(part[-1]) + n


def _write_blocks(benchmark: DataFrame) -> list[str]:
    """Writes the items in blocks of about BLOCK_BYTES, each by one task, to the shared folder; a name a block comes to the driver."""
    spark = benchmark.sparkSession
    rows = benchmark.select("item_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    with run_once(spark):
        total = rows.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    count = -(-int(total) // BLOCK_BYTES)
    path = new_path(spark, "benchmark")

    def write(key: tuple, table: pa.Table) -> pa.Table:
        name = f"{path}/{key[0].as_py()}"
        sink = pa.BufferOutputStream()
        table = table.select(["item_id", "text"]).sort_by([("item_id", "ascending"), ("text", "ascending")])
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        write_arrays(name, {"items": np.frombuffer(sink.getvalue(), np.uint8)})
        return pa.table({"name": [name]})

    if not count:
        return []
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(count)).cast("int"))
    with run_once(spark):
        return sorted(r["name"] for r in dealt.groupBy("block").applyInArrow(write, "name string").collect())


class _Blocks:
    """The indexes of the written blocks, one after another; a single one is made once a task."""

    def __init__(self, places: list[str], least: int):
        self.places, self.least = places, least
        self.only = self._open(places[0]) if len(places) == 1 else None

    def _open(self, place: str) -> Index:
        table = pa.ipc.open_stream(pa.py_buffer(map_arrays(place)["items"])).read_all()
        return Index(table["item_id"].combine_chunks(), table["text"].combine_chunks(), self.least)

    def __iter__(self) -> Iterator[Index]:
        return iter([self.only]) if self.only else (self._open(p) for p in self.places)


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = LEAST) -> DataFrame:
    """The contained items of every row of docs: doc_id, item_id, item_words, matched, coverage, tiles, longest.

    Clean rows give none. Words are compared without case (ASCII) and punctuation. Null and empty texts
    match nothing, items without words neither; one of fewer than ``least`` words is contained where all of
    them stand in a row; repeated rows and items each give their rows; an empty table on either side gives an empty result; other columns are ignored.
    """
    id_type, item_type = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, item_id {item_type}, item_words long, matched long, coverage double, tiles long, longest long"
    names = ["doc_id", "item_id", "item_words", "matched", "coverage", "tiles", "longest"]
    places = _write_blocks(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks(places, least)
        for batch in batches:
            for lo, hi in _slices(batch.column(1)):
                for index in blocks:
                    found = index.search(batch.column(1).slice(lo, hi - lo), coverage)
                    if not found:
                        continue
                    rows = pa.array([lo + f[0] for f in found])
                    size = [len(index.items[f[1]]) for f in found]
                    cover = [f[2] / s for f, s in zip(found, size, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(rows), index.ids.take(pa.array([f[1] for f in found])), pa.array(size, pa.int64()), pa.array([f[2] for f in found], pa.int64()),
                         pa.array(cover, pa.float64()), pa.array([f[3] for f in found], pa.int64()), pa.array([f[4] for f in found], pa.int64())],
                        names,
                    )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = LEAST) -> DataFrame:
    """The rows of docs, all columns, that contain no item of the benchmark.

    Null and empty texts contain nothing and stay; repeated rows share their fate; an empty benchmark keeps
    every row, an empty table stays empty.
    """
    column = docs.columns.index("text")
    places = _write_blocks(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks(places, least)
        for batch in batches:
            for lo, hi in _slices(batch.column(column)):
                keep = np.ones(hi - lo, dtype=bool)
                for index in blocks:
                    keep[[f[0] for f in index.search(batch.column(column).slice(lo, hi - lo), coverage)]] = False
                yield batch.slice(lo, hi - lo).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def _slices(column: pa.Array, size: int = 4 << 20) -> Iterator[tuple[int, int]]:
    _, at = tx.buffers(column)
    lo = 0
    while lo < len(column):
        hi = min(len(column), max(lo + 1, int(np.searchsorted(at, at[lo] + size, side="right")) - 1))
        yield lo, hi
        lo = hi
