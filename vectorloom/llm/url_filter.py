"""URL filters over a sorted digest array.

The keys (``host/path-prefix`` strings) are written once as one file: 64-bit xxhash digests in
ascending order, then offsets, actions and the full strings. Executors memory-map the file, probe
many digests at a time by vectorised binary search, and confirm each hit by the stored string, so a
digest collision never changes a verdict.
"""

from __future__ import annotations

import os
import struct
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame

from vectorloom.llm.shared import new_path

MAGIC = b"UDA1"
BLOCK, ALLOW = 0, 1

#: The rules of the production query: (host and path prefix, action).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: Hosts that the production query blocks, with their subdomains, where no rule fits.
BLOCKED_HOSTS = ("cheap-pills.example.com", "spam-farm.example.org")


class DigestArray:
    """A memory-mapped set of strings, each with an action.

    ``probe`` takes digests and returns for each the slot of the first equal digest or -1;
    ``find`` confirms strings and returns slots, following runs of equal digests.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            magic, n, size = struct.unpack("<4sqq", f.read(20))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a digest array")
        self.n = n
        at = 32
        self.digests = np.memmap(path, "<u8", "r", at, (n,)) if n else np.empty(0, "<u8")
        self.offsets = np.memmap(path, "<i8", "r", at + 8 * n, (n + 1,))
        self.actions = np.memmap(path, "u1", "r", at + 16 * n + 8, (n,)) if n else np.empty(0, "u1")
        self.strings = np.memmap(path, "u1", "r", at + 17 * n + 8, (size,)) if size else np.empty(0, "u1")

    @staticmethod
    def pack(entries: Iterable[tuple[str, int]]) -> bytes:
        """The file of (string, action) entries; of a repeated string the first entry counts."""
        first: dict[bytes, int] = {}
        for key, action in entries:
            first.setdefault(key.encode(), action)
        order = sorted(first, key=lambda k: (xxhash.xxh64_intdigest(k), k))
        digests = np.array([xxhash.xxh64_intdigest(k) for k in order], dtype="<u8")
        offsets = np.zeros(len(order) + 1, dtype="<i8")
        np.cumsum([len(k) for k in order], out=offsets[1:])
        actions = np.array([first[k] for k in order], dtype="u1")
        head = struct.pack("<4sqq", MAGIC, len(order), int(offsets[-1])).ljust(32, b"\0")
        return head + digests.tobytes() + offsets.tobytes() + actions.tobytes() + b"".join(order)

    def key(self, slot: int) -> bytes:
        return self.strings[self.offsets[slot] : self.offsets[slot + 1]].tobytes()

    def probe(self, digests: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.full(len(digests), -1, np.int64)
        slot = np.searchsorted(self.digests, digests)
        hit = self.digests[np.minimum(slot, self.n - 1)] == digests
        return np.where(hit & (slot < self.n), slot, -1)

    def find(self, keys: list[bytes]) -> np.ndarray:
        digests = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
        slots = self.probe(digests)
        for i in np.flatnonzero(slots >= 0):
            slot, want = int(slots[i]), digests[i]
            while slot < self.n and self.digests[slot] == want and self.key(slot) != keys[i]:
                slot += 1
            slots[i] = slot if slot < self.n and self.digests[slot] == want else -1
        return slots


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host: after the first :// up to / ? # or the end, ASCII-lowered; path: then up to ? or #."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    stop = min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    rest = rest[:stop]
    cut = rest.find("/")
    host, path = (rest, "") if cut < 0 else (rest[:cut], rest[cut:])
    return host.translate(_ASCII_LOWER), path


_ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


@dataclass(frozen=True)
class Shape:
    """Of a set of keys: the greatest length of a host, and the lengths of path prefixes, longest first."""

    host: int
    paths: tuple[int, ...]

    @staticmethod
    def of(keys: Iterable[str]) -> Shape:
        hosts = [k.partition("/")[0] for k in keys]
        return Shape(max(map(len, hosts), default=0), tuple(sorted({len(k) - len(h) for k, h in zip(keys, hosts, strict=True)}, reverse=True)))


def candidates(host: str, path: str, shape: Shape) -> Iterator[str]:
    """The keys that could fit: each domain suffix of the host that is no longer than a known one, with each known prefix length of the path."""
    prefixes = [path[:n] for n in shape.paths if n <= len(path)]
    if not host or not prefixes:
        return
    if len(host) <= shape.host:
        for p in prefixes:
            yield host + p
    at = host.find(".", max(0, len(host) - shape.host - 1))
    while at >= 0:
        if at + 1 < len(host):
            for p in prefixes:
                yield host[at + 1 :] + p
        at = host.find(".", at + 1)


def write_digest_array(spark, entries: Iterable[tuple[str, int]]) -> str:
    """Packs entries into a file of the shared folder and returns its URI."""
    path = new_path(spark, "digests")
    where, inner = fs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")
    where.create_dir(os.path.dirname(inner), recursive=True)
    with where.open_output_stream(inner) as f:
        f.write(DigestArray.pack(entries))
    return path


def open_digest_array(path: str) -> DigestArray:
    """Maps the file: in place where the shared folder is mounted, else through a copy that is unlinked at once."""
    where, inner = fs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")
    if isinstance(where, fs.LocalFileSystem):
        return DigestArray(inner)
    local = os.path.join(tempfile.gettempdir(), f"digests-{uuid.uuid4().hex}")
    try:
        fs.copy_files(inner, local, source_filesystem=where, destination_filesystem=fs.LocalFileSystem())
        return DigestArray(local)
    finally:
        if os.path.exists(local):
            os.unlink(local)


def filter_urls(
    pages: DataFrame,
    rules: Iterable[tuple[str, str]] = RULES,
    blocked: Iterable[str] = BLOCKED_HOSTS,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """One row per row of pages: (id, host, path, rule, verdict, listed).

    rules are (host/path-prefix, action); the longest that fits decides. Where none fits, the URL is
    blocked if its host or a parent domain is in ``blocked`` (itself a set of ``host`` or
    ``host/path-prefix`` keys), else allowed. listed is the key of ``blocked`` that fits, longest first.

    A null URL and one without ``://`` have an empty host and path and are allowed. Repeated rows each
    get a row; an empty table gives none; other columns of pages are ignored. Both key sets are
    parameters held by the driver; only the file's name travels with the tasks.
    """
    spark = pages.sparkSession
    rules, blocked = list(rules), list(blocked)
    rule_file = write_digest_array(spark, [(k, ALLOW if a == "allow" else BLOCK) for k, a in rules])
    list_file = write_digest_array(spark, [(k, BLOCK) for k in blocked])
    rule_shape, list_shape = Shape.of([k for k, _ in rules]), Shape.of(blocked)

    def longest(table: DigestArray, parts: list[tuple[str, str]], shape: Shape) -> list[tuple[str, int] | None]:
        owner, keys = [], []
        for i, (host, path) in enumerate(parts):
            for key in candidates(host, path, shape):
                owner.append(i)
                keys.append(key.encode("utf-8", "surrogatepass"))
        found: list[tuple[str, int] | None] = [None] * len(parts)
        slots = table.find(keys)
        for j in np.flatnonzero(slots >= 0):
            key = keys[j].decode("utf-8", "surrogatepass")
            best = found[owner[j]]
            if best is None or len(key) > len(best[0]):
                found[owner[j]] = (key, int(table.actions[slots[j]]))
        return found

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rule, by_list = open_digest_array(rule_file), open_digest_array(list_file)
        for batch in batches:
            parts = [host_and_path(u) for u in batch.column(1).to_pylist()]
            ruled, listed = longest(by_rule, parts, rule_shape), longest(by_list, parts, list_shape)
            verdicts = ["allow" if (r[1] == ALLOW if r else not b) else "block" for r, b in zip(ruled, listed, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([h for h, _ in parts], pa.string()),
                    pa.array([p for _, p in parts], pa.string()),
                    pa.array([r[0] if r else None for r in ruled], pa.string()),
                    pa.array(verdicts, pa.string()),
                    pa.array([b[0] if b else None for b in listed], pa.string()),
                ],
                ["id", "host", "path", "rule", "verdict", "listed"],
            )

    kind = pages.schema[id_col].dataType.simpleString()
    out = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url")).mapInArrow(
        judge, f"id {kind}, host string, path string, rule string, verdict string, listed string"
    )
    return out.withColumnRenamed("id", id_col)
