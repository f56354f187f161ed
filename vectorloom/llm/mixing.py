"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order, repeated up to ``repeats`` times. A
document instance ends at virtual time (words of its source up to and with it) / (target words of
the source). Instances are taken in order of virtual time until the word budget is reached.

No task ever sorts a whole source: prefix sums run over buckets of the shuffled order, then within each
bucket. The queue of all instances is range-sorted by virtual time, written in its ranges, and cut off where
the words of the ranges before and the running words within a range exceed the budget.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.llm.shared import cut, discard

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, repeating.
CYCLE = (1, 2, 3)
#: Rows that one bucket of a window is meant to hold, and instances that one range of the queue is.
BUCKET_ROWS, RANGE_ROWS = 4096, 100_000


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, cycle: tuple[int, ...] = CYCLE, repeats: int = 3) -> DataFrame:
    """One row per source: (source, source_size, target).

    Targets share the total size by weight; one that exceeds ``repeats`` times its source's size
    stops there and the excess is reshared by weight. Sources are ranked by how soon they fill up,
    so the share of the rest is known from running sums instead of repeated rounds.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    weights = F.array(*[F.lit(int(w)) for w in cycle])
    lcm = math.lcm(*cycle)
    ranked = by_source.withColumn("nth", F.row_number().over(everything.orderBy(F.col("source").isNull(), "source")) - 1)
    ranked = ranked.withColumn("w", F.element_at(weights, (F.col("nth") % len(cycle) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("most", F.col("source_size") * repeats)
    soon = everything.orderBy(F.col("most") * (F.lit(lcm) / F.col("w")).cast("long"), "nth")
    before = soon.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        ranked.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0)))
        .withColumn("open", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("full", F.col("left") * F.col("w") >= F.col("most") * F.col("open"))
    )
    first_open = F.min_by(F.struct("left", "open"), F.struct(F.col("full").cast("int"), F.col("most") * (F.lit(lcm) / F.col("w")).cast("long"), F.col("nth")))
    ranked = ranked.withColumn("share", first_open.over(everything))
    return ranked.select(
        "source",
        "source_size",
        F.when(F.col("full"), F.col("most").cast("double"))
        .otherwise((F.col("share.left") * F.col("w")).cast("double") / F.col("share.open").cast("double"))
        .alias("target"),
    )


def mix_sources(docs: DataFrame, cycle: tuple[int, ...] = CYCLE, repeats: int = 3, seed: str = "mix") -> DataFrame:
    """One row per row of docs: (doc_id, source, size, source_size, target, taken).

    size: words of the text (null: 0). target: of the row's source. taken: words the mix takes, a
    multiple of size, at most ``repeats`` times it. Instances of equal virtual time are taken together
    or not at all. A null source is a source of its own, last in order; a null doc_id and repeated
    rows are shuffled like others; texts without words are never taken; an empty table gives none.
    Other columns of docs are not read.
    """
    # the text is scanned once; everything below runs on this small table. Rows without an id are shuffled by text
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))
    order = F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary"))
    sizes = cut(docs.select("doc_id", "source", count_words(F.col("text")).alias("size"), order.alias("_order")), "sized")
    stats = sizes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("total")).first()
    digits = max(0, math.ceil(math.log(max(1, stats["n"]) / BUCKET_ROWS, 16))) if stats["n"] else 0
    total = int(stats["total"])
    targets = source_targets(sizes, cycle, repeats)

    # each row's place in its source's queue
    placed = sizes.withColumn("_bucket", F.substring("_order", 1, digits) if digits else F.lit(""))
    sums = placed.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    running = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "_bucket", F.coalesce(F.sum("_sum").over(running), F.lit(0)).alias("_offset"))
    offsets = offsets.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).select(
        F.col("source").alias("_source"), F.col("_bucket").alias("_b"), "_offset", "source_size", "target"
    )
    within = Window.partitionBy("source", "_bucket").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        placed.withColumn("_run", F.sum("size").over(within))
        .join(offsets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_b")))
        .select("doc_id", "source", "size", "source_size", "target", (F.col("_run") + F.col("_offset")).alias("_end"))
    )
    placed = cut(placed, "placed")
    discard(sizes)
    live = (F.col("size") > 0) & (F.col("target") > 0)

    def ends_at(epoch: int) -> Column:
        return (F.col("source_size") * epoch + F.col("_end")).cast("double") / F.col("target")

    # the queue: a range holds all instances of its virtual times
    instances = placed.where(live).select("size", F.explode(F.array(*[ends_at(e) for e in range(repeats)])).alias("time"))
    ranges = max(1, -(-stats["n"] * repeats // RANGE_ROWS))
    queue = cut(instances.repartitionByRange(ranges, "time").select("size", "time", F.spark_partition_id().alias("range")), "queue")
    by_range = queue.groupBy("range").agg(F.sum("size").alias("words"))
    before = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    opened = by_range.select(F.col("range").alias("_range"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("_before")).where(F.col("_before") <= total)
    by_time = Window.partitionBy("range").orderBy("time").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    upto = queue.join(opened, F.col("range") == F.col("_range")).select("time", (F.col("_before") + F.sum("size").over(by_time)).alias("upto"))
    last = upto.where(F.col("upto") <= total).agg(F.max("time").alias("last")).first()["last"]
    discard(queue)
    last = -1.0 if last is None else last
    times = sum((F.when(ends_at(e) <= F.lit(last), 1).otherwise(0) for e in range(repeats)), F.lit(0))
    taken = F.when(live, F.col("size") * times).otherwise(F.lit(0)).cast("long")
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))
