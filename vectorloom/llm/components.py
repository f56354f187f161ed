"""Connected components of a table of links, by contraction; nothing but counts comes to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.shared import cut, discard, run_once

#: Links that one task contracts by itself.
TASK_LINKS = 400_000


def smallest_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ascending, and the smallest id that the links a - b reach from each)."""
    ids, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    root = np.arange(len(ids))
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
    return ids, ids[root]


def _contracted(links: DataFrame, tasks: int) -> DataFrame:
    """Links (a, b) of the same components: within each task's links every id is linked to the smallest it reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if held:
            ids, low = smallest_reached(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(ids)], ["a", "b"])

    links = links.select("a", "b")
    dealt = links.repartition(1) if tasks <= 1 else links.repartition(tasks, "a", "b")
    return dealt.mapInArrow(run, "a long, b long")


def _settled(near: DataFrame) -> bool:
    """Whether no id is in the links of two tasks: then each component is within one task, as it was contracted."""
    with run_once(near.sparkSession):
        return near.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(id, comp) of every id in links (a, b): comp is the smallest id that links reach.

    Each round, tasks contract the links they hold, a bounded number; then every root joins its smallest
    neighbouring root and the links are relabelled. Links within a component vanish, so that rounds grow
    with the logarithm of the longest chain, and what one task can hold takes one round. The rounds end when
    no id is in two tasks, in however many tasks Spark has run them.
    The result is a written table; the tables of earlier rounds are deleted.
    """
    edges = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while True:
        tasks = -(-edges.count() // TASK_LINKS)
        near = cut(_contracted(edges, tasks), "stars")
        discard(edges)
        if _settled(near):
            found = near.select(F.col("b").alias("id"), F.col("a").alias("comp"))
            if labels is None:
                found._cut_path = near._cut_path
                return found
            last = cut(_renamed(labels, found), "labels")
            discard(labels, near)
            return last
        # an id may have a root in each of several tasks
        parent = near.groupBy("b").agg(F.min("a").alias("p")).select(F.col("b").alias("id"), F.col("p").alias("comp"))
        parent = cut(parent, "parents")
        labels_before, labels = labels, cut(parent if labels is None else _renamed(labels, parent), "labels")
        one = near.join(parent, F.col("a") == F.col("id")).select("b", F.col("comp").alias("x"))
        both = one.join(parent, F.col("b") == F.col("id")).select("x", F.col("comp").alias("y")).where("x <> y")
        edges = cut(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        discard(near, parent, *([labels_before] if labels_before is not None else []))


def _renamed(labels: DataFrame, found: DataFrame) -> DataFrame:
    """labels with each comp replaced by what it reaches."""
    to = found.select(F.col("id").alias("_from"), F.col("comp").alias("_to"))
    return labels.join(to, F.col("comp") == F.col("_from"), "left").select("id", F.coalesce("_to", "comp").alias("comp"))
