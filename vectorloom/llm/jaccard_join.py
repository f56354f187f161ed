"""N-gram Jaccard join by universe partition and pigeonhole.

Sets of shingle hashes fall into bands of size. A band has so many segments that two sets of its
space whose similarity reaches the threshold agree on one segment, or differ there by one element:
each exact segment counts one, each with its one-deletion neighbourhood two, and together they exceed
the greatest possible difference.

1. Equal sets are one class, known by its smallest doc_id.
2. All classes are indexed by segment signatures. Members of a bucket are verified against its
   smallest member only; the links found are contracted to components.
3. Buckets that still hold several components stay open, for sets that have enough of them. Their sets
   go through a second index, of exact segments and one-deletion neighbourhoods. There each set, from the
   true lengths of its lists, chooses by cost which segments to probe exactly, with deletions, or not at all.
4. Sets whose cheapest choice is still long lists are crowded: near copies of one text, or texts around one
   passage. Sets whose buckets are connected are compared with one of them, the reference, and known by
   their differences from it. Two sets differ as their differences do, so that what the group has in
   common is gone; linked ones share one of the rarest elements of their differences, and are looked up by it.
5. What was brought together is verified exactly. No pair within a component is made.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.llm import text as tx
from vectorloom.llm.components import components
from vectorloom.llm.id_filter import IdFilter
from vectorloom.llm.shared import cut, discard

_U = np.uint64
#: Signatures that a task sends on at once.
BATCH_SIGNATURES = 100_000
_SEGMENT, _TERM, _SET = _U(0x8CB92BA72F3D8DD7), _U(0xABC98388FB8FAC03), _U(0x139408DCBBF7A44F)


@dataclass(frozen=True)
class Plan:
    """Bands of size for one threshold, num / 100."""

    num: int

    def top(self, size: int) -> int:
        """The greatest size of a set that a set of this size can link to."""
        return size * 100 // self.num

    def difference(self, total: int) -> int:
        """The greatest symmetric difference of linked sets whose sizes add up to total."""
        return total * (100 - self.num) // (100 + self.num)

    def bands(self, largest: int) -> list[int]:
        """Least size of each band. A set links within its band and the next one only."""
        at = [1]
        while at[-1] <= largest:
            at.append(max(at[-1] + 1, at[-1] * 10000 // (self.num * self.num)))
        return [*at, max(at[-1] + 1, at[-1] * 10000 // (self.num * self.num))]

    def needed(self, last: int) -> int:
        """What the segments of a band whose largest size is last must count together."""
        return self.difference(2 * last) + 1

    def allocation(self, last: int) -> tuple[int, int]:
        """(segments, how many of them with deletions) of the first index.

        Deletions cost a row for each element, so they are used where sets are small: there exact
        segments would often be empty and equal by chance. Elsewhere there are an eighth more segments
        than needed, so that a set may leave its longest lists out.
        """
        need = self.needed(last)
        if need <= 4:
            return (need + 1) // 2, need // 2
        return need + max(2, need // 8), 0

    def need(self, size: int, last: int) -> int:
        """What the segments that a set of this size probes must count together in a space up to last."""
        return self.difference(size + min(last, self.top(size))) + 1

    def slack(self, size: int, last: int) -> int:
        """How many exact segments of the first index the set may leave out; -1 where there are deletions."""
        segments, deletions = self.allocation(last)
        return -1 if deletions else segments - self.need(size, last)


def _segment_sums(term: np.ndarray, where: np.ndarray, count: int) -> np.ndarray:
    """Sums modulo 2^64 of term by where, exact."""
    out = np.zeros(count, dtype=np.uint64)
    for shift in (0, 22, 44):
        piece = ((term >> _U(shift)) & _U((1 << 22) - 1)).astype(np.float64)
        out += np.bincount(where, piece, count).astype(np.uint64) << _U(shift)
    return out


def _salts(band: int, segments: int) -> np.ndarray:
    return tx.mix((np.arange(segments, dtype=np.uint64) + _U(1)) * _SEGMENT + _U(band * int(_SET) % (1 << 64)))


def signatures(elements: np.ndarray, band: int, segments: int, deletions: int) -> np.ndarray:
    """Exact segment signatures of a set in a band's space, then one-deletion ones of the first segments."""
    place = (((tx.mix(elements) >> _U(32)) * _U(segments)) >> _U(32)).astype(np.int64)
    term = tx.mix(elements ^ _TERM)
    sums = _segment_sums(term, place, segments)
    salts = _salts(band, segments)
    exact = tx.mix(sums ^ salts)
    if not deletions:
        return exact
    near = place < deletions
    return np.concatenate((exact, tx.mix((sums[place[near]] - term[near]) ^ salts[place[near]])))


class Bander:
    """Bands for sizes up to the largest seen; grows as needed."""

    def __init__(self, plan: Plan):
        self.plan, self.starts = plan, plan.bands(1)

    def spaces(self, size: int) -> list[tuple[int, int, bool]]:
        """(band, its largest size, guest) of the spaces in which a set of this size takes part."""
        if size >= self.starts[-2]:
            self.starts = self.plan.bands(size * 2)
        band = int(np.searchsorted(self.starts, size, "right")) - 1
        out = [(band, self.starts[band + 1] - 1, False)]
        if self.plan.top(size) >= self.starts[band + 1]:
            out.append((band + 1, self.starts[band + 2] - 1, True))
        return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(_signed(flat)))


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """(ids, sets of shingle hashes) of slices of (id, text) batches."""
    for batch in batches:
        _, at = tx.buffers(batch.column(1))
        lo = 0
        while lo < batch.num_rows:
            hi = min(batch.num_rows, max(lo + 1, int(np.searchsorted(at, at[lo] + (4 << 20), side="right")) - 1))
            hashes, bounds, _, _ = tx.word_hashes(batch.column(1).slice(lo, hi - lo))
            found, first = tx.all_shingles(hashes, bounds, words)
            yield batch.column(0).slice(lo, hi - lo), [np.unique(found[first[i] : first[i + 1]]) for i in range(hi - lo)]
            lo = hi


def _first_index(docs: DataFrame, words: int, plan: Plan, signed: bool) -> DataFrame:
    """(doc_id, n, h1, h2, own, own_slack, guest, guest_slack) of every row of docs.

    own and guest: signatures in the set's own space and in the next one, if signed; else empty. They are
    made in a second pass instead of being kept, which costs less than a table of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bander = Bander(plan)
        for ids, sets in _sets(batches, words):
            lists: tuple[list, list] = ([], [])
            slacks: tuple[list, list] = ([], [])
            held, begun = 0, 0
            for i, s in enumerate(sets):
                spaces = bander.spaces(len(s)) if len(s) else []
                for k in (0, 1):
                    if k < len(spaces):
                        band, last, _ = spaces[k]
                        lists[k].append(np.unique(signatures(s, band, *plan.allocation(last))) if signed else s[:0])
                        slacks[k].append(plan.slack(len(s), last))
                    else:
                        lists[k].append(s[:0])
                        slacks[k].append(0)
                    held += len(lists[k][-1])
                if held < BATCH_SIGNATURES and i + 1 < len(sets):
                    continue
                part = sets[begun : i + 1]
                h1 = np.array([int(s.sum()) if len(s) else 0 for s in part], dtype=np.uint64)
                h2 = np.array([int(tx.mix(s ^ _SET).sum()) if len(s) else 0 for s in part], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(begun, len(part)), pa.array([len(s) for s in part], pa.int64()), pa.array(_signed(h1)), pa.array(_signed(h2)),
                        _lists(lists[0]), pa.array(slacks[0], pa.int32()), _lists(lists[1]), pa.array(slacks[1], pa.int32()),
                    ],
                    ["doc_id", "n", "h1", "h2", "own", "own_slack", "guest", "guest_slack"],
                )
                lists, slacks, held, begun = ([], []), ([], []), 0, i + 1

    return docs.mapInArrow(run, "doc_id long, n long, h1 long, h2 long, own array<long>, own_slack int, guest array<long>, guest_slack int")


def _buckets(first: DataFrame, members: DataFrame) -> DataFrame:
    """(sig, rep, guest, slack) of signatures that several classes have."""
    both = F.array(
        F.struct(F.lit(False).alias("guest"), F.col("own").alias("sigs")),
        F.struct(F.lit(True).alias("guest"), F.col("guest").alias("sigs")),
    )
    rows = first.where("doc_id IS NOT NULL AND n > 0").select("doc_id", F.explode(both).alias("x")).select("doc_id", "x.guest", F.explode("x.sigs").alias("sig")).repartition("sig")
    # the same columns on both sides, so that the rows are shuffled once
    many = rows.groupBy("sig").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min("guest").alias("g")).where("lo < hi AND NOT g").select("sig")
    reps = members.where("rep IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "rep", "own_slack", "guest_slack").distinct()
    shared = rows.join(many, "sig").join(reps, "doc_id")
    return shared.select("sig", "rep", "guest", F.when(F.col("guest"), F.col("guest_slack")).otherwise(F.col("own_slack")).alias("slack")).distinct()


#: Rounds in which sets leave their buckets; each round lets others leave.
PEELS = 3


def _peeled(shared: DataFrame) -> DataFrame:
    """shared with pivot, without the sets that need not probe any bucket.

    A set may choose which segments it probes, as long as they count what is needed: one that can do
    with segments that no other set has is proved to link with nothing in that space and leaves it.
    """
    made = None
    for _ in range(PEELS):
        staying = shared.groupBy("rep", "guest").agg(F.count(F.lit(1)).alias("n"), F.max("slack").alias("s")).where("n > s").select("rep", "guest")
        shared = shared.join(staying, ["rep", "guest"], "left_semi")
        sizes = shared.groupBy("sig").agg(F.min("rep").alias("pivot"), F.count(F.lit(1)).alias("n"), F.min("guest").alias("g")).where("n > 1 AND NOT g").select("sig", "pivot")
        before, made = made, cut(shared.join(sizes, "sig").select("sig", "rep", "guest", "slack", "pivot"), "buckets")
        shared = made.drop("pivot")
        if before is not None:
            discard(before)
    return made


def _sets_of(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(doc_id, elements) of the documents in ids (id).

    Texts are not shuffled: a bit filter of bounded size lets through those that may be in ids, and the
    sets made of these are joined with ids.
    """
    chosen = IdFilter(ids)
    shared = chosen.shared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = (b.filter(pa.array(IdFilter.hits(shared.value, b.column(2)))) for b in batches)
        for found, sets in _sets(wanted, words):
            yield pa.RecordBatch.from_arrays([found, _lists(sets)], ["doc_id", "elements"])

    made = docs.select("doc_id", "text", chosen.slot(F.col("doc_id")).alias("slot")).mapInArrow(run, "doc_id long, elements array<long>")
    return made.join(ids, F.col("doc_id") == F.col("id"), "left_semi")


def _verified(pairs: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("elements").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", common)
    return both.where(F.col("common") * 100 >= plan.num * (F.size("x") + F.size("y") - F.col("common"))).select("a", "b")


def _labelled(rows: DataFrame, labels: DataFrame, column: str, out: str) -> DataFrame:
    """rows with the component of a column; an id without links is its own."""
    names = labels.select(F.col("id").alias("_id"), F.col("comp").alias("_comp"))
    return rows.join(names, F.col(column) == F.col("_id"), "left").withColumn(out, F.coalesce("_comp", column)).drop("_id", "_comp")


def _second_index(sets: DataFrame, plan: Plan) -> DataFrame:
    """(doc_id, comp, space, guest, need, seg, kind, sig): exact segments (kind 0) and deletions (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bander = Bander(plan)
        for batch in batches:
            for i in range(batch.num_rows):
                elements = np.asarray(batch.column(1)[i].values).view(np.uint64)
                n = len(elements)
                for band, last, guest in bander.spaces(n):
                    if not batch.column(4 if guest else 3)[i].as_py():
                        continue  # nothing is open in this space
                    m = plan.needed(last)
                    sigs = signatures(elements, band, m, m)
                    place = (((tx.mix(elements) >> _U(32)) * _U(m)) >> _U(32)).astype(np.int32)
                    seg = np.concatenate((np.arange(m, dtype=np.int32), place))
                    need = plan.need(n, last)
                    k = len(sigs)
                    full = lambda v, kind, k=k: pa.array(np.full(k, v), kind)
                    yield pa.RecordBatch.from_arrays(
                        [
                            full(batch.column(0)[i].as_py(), pa.int64()), full(batch.column(2)[i].as_py(), pa.int64()),
                            full(band, pa.int32()), full(guest, pa.bool_()), full(need, pa.int32()), pa.array(seg), pa.array((np.arange(k) >= m).astype(np.int32)), pa.array(_signed(sigs)),
                        ],
                        ["doc_id", "comp", "space", "guest", "need", "seg", "kind", "sig"],
                    )

    return sets.select("doc_id", "elements", "comp", "as_own", "as_guest").mapInArrow(run, "doc_id long, comp long, space int, guest boolean, need int, seg int, kind int, sig long")


def allocate(need: int, exact: np.ndarray, near: np.ndarray) -> np.ndarray:
    """For each segment 0 (skip), 1 (exact) or 2 (with deletions): the least total cost of counting to need.

    Costs of near are at least those of exact, so that no best choice counts more than need + 1.
    """
    m = len(exact)
    best = np.full(need + 2, np.inf)
    best[0] = 0
    chosen = np.zeros((m, need + 2), dtype=np.int8)
    for i in range(m):
        after = best.copy()
        for weight, cost in ((1, exact[i]), (2, near[i])):
            moved = best[: need + 2 - weight] + cost
            better = moved < after[weight:]
            after[weight:][better] = moved[better]
            chosen[i, weight:][better] = weight
        best = after
    out = np.zeros(m, dtype=np.int8)
    left = need if best[need] <= best[need + 1] else need + 1
    for i in range(m - 1, -1, -1):
        out[i] = chosen[i, left]
        left -= int(out[i])
    return out


#: Members of lists, besides itself, that a set looks at through the second index at most; beyond this it is crowded.
CROWDED = 32


def _probes(rows: DataFrame) -> DataFrame:
    """The rows (sig) that each set probes, by the true lengths of the lists; deep: deletions of others count too.

    rows: the second index with exact_n and near_n, the lengths of the lists of sig. A set whose cheapest
    lists are too long gives one row without a sig.
    """
    names = ["doc_id", "comp", "space", "guest", "kind", "sig", "deep"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(table: pa.Table) -> pa.Table:
            seg, kind = table["seg"].to_numpy(), table["kind"].to_numpy()
            exact_n, near_n = table["exact_n"].to_numpy().astype(np.float64), table["near_n"].to_numpy().astype(np.float64)
            m = int(seg.max()) + 1
            exact, near = np.zeros(m), np.zeros(m)
            whole = kind == 0
            # its own row is in each of its exact lists
            exact[seg[whole]] = exact_n[whole] - 1
            near[seg[whole]] = exact_n[whole] - 1 + near_n[whole]
            np.add.at(near, seg[~whole], exact_n[~whole])
            chosen = allocate(int(table["need"][0].as_py()), exact, near)
            if exact[chosen == 1].sum() + near[chosen == 2].sum() > CROWDED:
                return table.slice(0, 1).select(names[:5]).append_column("sig", pa.array([None], pa.int64())).append_column("deep", pa.array([False]))
            chosen = chosen[seg]
            keep = (chosen == 2) | ((chosen == 1) & whole)
            return table.select(names[:6]).append_column("deep", pa.array((chosen == 2) & whole)).filter(pa.array(keep))

        def sent(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if parts:
                yield from done(pa.Table.from_batches(parts)).combine_chunks().to_batches()

        for batch in batches:
            key = batch.column(0).to_numpy() * 2 + batch.column(3).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(a, b - a)
                if held and (held[-1].column(0)[0] != part.column(0)[0] or held[-1].column(3)[0] != part.column(3)[0]):
                    yield from sent(held)
                    held = []
                held.append(part)
        yield from sent(held)

    ordered = rows.select("doc_id", "comp", "space", "guest", "kind", "sig", "need", "seg", "exact_n", "near_n").repartition("doc_id").sortWithinPartitions("doc_id", "guest")
    return ordered.mapInArrow(run, "doc_id long, comp long, space int, guest boolean, kind int, sig long, deep boolean")


def _looked_up(index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs (a, b) of different components that the second index brings together, crowded sets (id))."""
    lengths = index.groupBy("sig").agg(F.sum(F.lit(1) - F.col("kind")).alias("exact_n"), F.sum("kind").alias("near_n"))
    probes = cut(_probes(index.join(lengths, "sig")), "probes")
    there = index.select(F.col("doc_id").alias("o"), F.col("comp").alias("o_comp"), F.col("guest").alias("o_guest"), F.col("kind").alias("o_kind"), "sig")
    met = probes.where("sig IS NOT NULL").join(there, "sig").where((F.col("comp") != F.col("o_comp")) & ~(F.col("guest") & F.col("o_guest")) & ((F.col("o_kind") == 0) | F.col("deep")))
    pairs = cut(met.select(F.least("doc_id", "o").alias("a"), F.greatest("doc_id", "o").alias("b")).distinct(), "pairs")
    crowded = cut(probes.where("sig IS NULL").select(F.col("doc_id").alias("id")).distinct(), "crowded")
    discard(probes)
    return pairs, crowded


def _still_open(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """(sig, rep, guest, slack, pivot, comp) of buckets that hold several components besides their pivot.

    Linked sets share more buckets than either may leave out. Each of these is open while the two are in
    different components, and neither is its pivot, with which all are verified: a set with fewer open
    buckets has found all its links.
    """
    rows = _labelled(shared.where("rep <> pivot"), labels, "rep", "comp")
    out = None
    for _ in range(PEELS):
        open_ = rows.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("sig")
        rows = rows.join(open_, "sig", "left_semi")
        enough = rows.groupBy("rep", "guest").agg(F.count(F.lit(1)).alias("n"), F.max("slack").alias("s")).where("n > s").select("rep", "guest")
        rows = cut(rows.join(enough, ["rep", "guest"], "left_semi"), "open")
        if out is not None:
            discard(out)
        out = rows
    return out


def _references(still: DataFrame) -> DataFrame:
    """(id, ref) of the sets in open buckets: ref is, of the pivots connected by buckets, the one that most sets meet."""
    edges = still.select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    groups = components(edges)
    met = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).join(groups, F.col("a") == F.col("id"))
    refs = met.groupBy("comp").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("ref"))
    return groups.join(refs, "comp").select("id", "ref")


def _differences(crowded: DataFrame, refs: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """(ref, rep, comp, n, a, linked, u) of crowded sets (id, comp): u is what the set and its reference do not share, a its size."""
    num = plan.num

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, other = batch.column(3), batch.column(4)
            for lo in range(0, batch.num_rows, 64):
                rows = range(lo, min(lo + 64, batch.num_rows))
                unlike = [np.setxor1d(np.asarray(own[i].values).view(np.uint64), np.asarray(other[i].values).view(np.uint64), True) for i in rows]
                n = np.array([len(own[i]) for i in rows], dtype=np.int64)
                a = np.array([len(u) for u in unlike], dtype=np.int64)
                linked = a * (100 + num) <= (n + np.array([len(other[i]) for i in rows])) * (100 - num)
                part = batch.slice(lo, len(unlike))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(n), pa.array(a), pa.array(linked), _lists(unlike)], ["ref", "rep", "comp", "n", "a", "linked", "u"])

    whose = crowded.join(refs, "id").join(sets, F.col("id") == F.col("doc_id")).select("ref", F.col("id").alias("rep"), "comp", "elements")
    reference = sets.join(refs.select("ref").distinct(), F.col("doc_id") == F.col("ref"), "left_semi").select(F.col("doc_id").alias("r"), F.col("elements").alias("r_elements"))
    both = whose.join(reference, F.col("ref") == F.col("r")).select("ref", "rep", "comp", "elements", "r_elements")
    return both.mapInArrow(run, "ref long, rep long, comp long, n long, a long, linked boolean, u array<long>")


def _apart(differences: DataFrame, plan: Plan) -> DataFrame:
    """Pairs (a, b) of crowded sets of different components that may link, by the rarest elements of their differences.

    Of sets with differences of a >= b elements that are linked, their own difference being h at most, the
    differences share t = (a + b - h) / 2 elements or more, which is above 0 unless both are linked to the
    reference. So one of the first a - t + 1 elements of the one is among the first b - t + 1 of the other,
    in any order that both keep: at most h + 1 and h / 2 + 1.
    """
    num = plan.num
    elements = differences.select("ref", "rep", "comp", "n", "a", F.explode("u").alias("e"))
    counts = elements.groupBy("ref", "e").agg(F.count(F.lit(1)).alias("times"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("times > 1")
    # only elements that several differences have are looked at; the others, which come first, are as many as these leave of a
    common = elements.join(counts, ["ref", "e"])
    alone = F.col("a") - F.count(F.lit(1)).over(Window.partitionBy("rep"))
    ranked = common.withColumn("place", (alone + F.row_number().over(Window.partitionBy("rep").orderBy("times", "e")) - 1).cast("int"))
    most = F.expr(f"((n + (n * 100) div {num}) * {100 - num}) div {100 + num}")
    first = cut(ranked.where(F.col("lo") < F.col("hi")).where(F.col("place") <= most).select("ref", "e", "rep", "comp", "n", "a", "place", most.alias("most")), "rare")
    small = first.where("2 * place <= most").select("ref", "e", F.col("rep").alias("o"), F.col("comp").alias("o_comp"), F.col("n").alias("o_n"), F.col("a").alias("o_a"), F.col("place").alias("o_place"))
    h = f"((n + o_n) * {100 - num}) div {100 + num}"
    pairs = first.join(small, ["ref", "e"]).where(
        f"comp <> o_comp AND (o_a < a OR (o_a = a AND o < rep)) AND 2 * place <= a - o_a + {h} AND 2 * o_place <= o_a - a + {h} AND a + o_a > {h}"
    )
    out = cut(pairs.select(F.least("rep", "o").alias("a"), F.greatest("rep", "o").alias("b")).distinct(), "pairs")
    discard(first)
    return out


#: Rows into which the rows of one class are dealt while they are told its name.
SALTS = 8


def jaccard_components(docs: DataFrame, words: int = 3, threshold: int = 90) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, copies (rows with the same set).

    Two rows link when the Jaccard similarity of their sets of word shingles is at least threshold / 100.
    component_id is the smallest doc_id that links reach. A text with fewer words is one shingle; a null
    or empty one has none and links with nothing, so that its component is its own doc_id. Equal sets are
    always linked. Rows with a null doc_id lend no links to others: they get the component of the rows
    with the same set, or null. Repeated rows each get a row; an empty table none; other columns are not read.
    """
    plan = Plan(threshold)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = cut(_first_index(docs, words, plan, signed=False).drop("own", "guest"), "sizes")
    key = ["n", "h1", "h2"]
    classes = first.where("n > 0").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    classes = classes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = first.select("doc_id", *key, "own_slack", "guest_slack").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    members = salted.join(classes, [*key, "salt"], "left").drop("salt")
    members = cut(members.withColumn("rep", F.when(F.col("n") > 0, F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("rep")))), "classes")
    discard(first)
    found = cut(_buckets(_first_index(docs, words, plan, signed=True), members), "buckets")
    shared = _peeled(found)
    discard(found)
    stars = cut(shared.where("rep <> pivot").groupBy(F.col("pivot").alias("a"), F.col("rep").alias("b")).agg(F.count(F.lit(1)).alias("common")), "stars")
    involved = cut(stars.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "involved")
    sets = cut(_sets_of(docs, involved, words), "sets")
    discard(involved)

    # first the pivot that a set shares most buckets with, then the others that are in other components
    best = cut(stars.groupBy("b").agg(F.max_by("a", F.struct("common", -F.col("a"))).alias("a")).select("a", "b"), "pairs")
    links = [cut(_verified(best, sets, plan), "links")]
    labels = components(links[0])
    rest = stars.select("a", "b").join(best, ["a", "b"], "left_anti")
    rest = _labelled(_labelled(rest, labels, "a", "x"), labels, "b", "y").where("x <> y").select("a", "b")
    links.append(cut(_verified(rest, sets, plan), "links"))
    discard(labels, best, stars)
    labels = components(links[0].unionByName(links[1]))

    # what buckets with several components leave open
    still = _still_open(shared, labels)
    discard(shared)
    if not still.isEmpty():
        open_sets = cut(still.groupBy("rep", "comp").agg(F.max(~F.col("guest")).alias("as_own"), F.max("guest").alias("as_guest")), "unsettled")
        index = cut(_second_index(sets.join(open_sets, F.col("doc_id") == F.col("rep")), plan), "index")
        pairs, crowded = _looked_up(index)
        discard(index)
        links.append(cut(_verified(pairs, sets, plan), "links"))
        discard(pairs)
        if not crowded.isEmpty():
            refs = cut(_references(still), "references")
            crowd = crowded.join(open_sets, F.col("id") == F.col("rep")).select("id", "comp")
            differences = cut(_differences(crowd, refs, sets, plan), "differences")
            links.append(cut(differences.where("linked AND ref <> rep").select(F.least("ref", "rep").alias("a"), F.greatest("ref", "rep").alias("b")), "links"))
            pairs = _apart(differences, plan)
            links.append(cut(_verified(pairs, sets, plan), "links"))
            discard(pairs, differences, refs)
        discard(open_sets, crowded, labels)
        every = links[0]
        for more in links[1:]:
            every = every.unionByName(more)
        labels = components(every)
    discard(still, sets, *links)
    out = _labelled(members.withColumn("own", F.coalesce("rep", F.when(F.col("n") == 0, F.col("doc_id")))), labels, "own", "component_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce("copies", F.lit(1)).alias("copies"))


def keep_one_of_each(docs: DataFrame, words: int = 5, threshold: int = 80) -> DataFrame:
    """The rows of docs, all columns, that are the smallest doc_id of their component; unlinked rows stay.

    Null and empty texts link with nothing and stay; rows with a null doc_id stay, as nothing tells them from
    others; repeated rows of the smallest doc_id all stay. An empty table stays empty.
    """
    found = jaccard_components(docs, words, threshold)
    # a null doc_id cannot be told from others; such rows stay
    gone = cut(found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    return IdFilter(gone).without(docs, "doc_id")
