"""Mixing sources to target weights by subset-sum budget fitting.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share `share` times all words; a
target stops at `most` times its source's words, the excess goes to the others by weight.

Fit of one source: whole copies first, then one more copy of some documents. Those are chosen by their exact
lengths: each length gets its even part of the rest, what then remains goes to the longest lengths that fit, down
to a budget of `window` words, and a bounded-knapsack dynamic program over the left-over lengths fills that budget
as exactly as the lengths allow. If a gap is left, up to `window` words of taken copies are given back, shortest
first, and the program runs over all that is free then. Which documents of a length are taken follows a seeded hash.

Only counts by (source, length) and by (source, length, hash bucket) are gathered: a source may hold any share of
the rows. A source has as many distinct lengths as its documents have, at most the longest document's length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brieflake.llm.common import WORD_RE, materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
WINDOW = 1 << 16
BUCKETS = 64
BUCKET_ROWS = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Copies of each length (0..counts) whose total is the largest that doesn't exceed budget."""
    taken = np.zeros(len(lengths), np.int64)
    order = [i for i in np.argsort(-lengths, kind="stable") if 0 < lengths[i] <= budget and counts[i] > 0]
    if not order or budget <= 0:
        return taken
    first = np.full(budget + 1, -1, np.int32)  # the type that reached a sum first
    used = np.zeros(budget + 1, np.int32)  # copies of that type at that sum
    reached = np.zeros(budget + 1, bool)
    reached[0] = True
    for i in order:
        step = int(lengths[i])
        front = np.flatnonzero(reached)
        for copies in range(1, int(min(counts[i], budget // step)) + 1):
            front = front + step
            front = front[front <= budget]
            front = front[~reached[front]]
            if not len(front):
                break
            reached[front] = True
            first[front] = i
            used[front] = copies
        if reached[budget]:
            break
    at = int(np.flatnonzero(reached)[-1])
    while at > 0:
        i = int(first[at])
        taken[i] += used[at]
        at -= int(used[at]) * int(lengths[i])
    return taken


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int = WINDOW) -> np.ndarray:
    """How many documents of each length get one copy so that their words come nearest below budget."""
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    # whole-number division: exact for any size
    taken = np.array([int(c) * budget // total for c in counts], np.int64)
    left = budget - int((taken * lengths).sum())
    spare = counts - taken
    for i in np.argsort(-lengths, kind="stable"):
        if left <= window:
            break
        if lengths[i] > 0:
            k = min(int(spare[i]), (left - window) // int(lengths[i]))
            taken[i] += k
            spare[i] -= k
            left -= k * int(lengths[i])
    return taken + knapsack(lengths, spare, left)


def copies_by_length(lengths: np.ndarray, counts: np.ndarray, target: int, most: int = MOST, window: int = WINDOW) -> np.ndarray:
    """Copies of the documents of each length in all, at most `most` each; their words come nearest below target."""
    total = int((lengths * counts).sum())
    whole = min(target // total, most) if total else 0
    have = counts * whole
    if whole < most and total:
        have = have + fit(lengths, counts, target - whole * total, window)
    gap = min(target, most * total) - int((have * lengths).sum())
    if gap > 0:
        back, free = np.zeros(len(lengths), np.int64), window
        for i in np.argsort(lengths, kind="stable"):
            if lengths[i] > 0:
                back[i] = min(int(have[i]), free // int(lengths[i]))
                free -= int(back[i] * lengths[i])
        have = have - back
        have = have + knapsack(lengths, most * counts - have, gap + int((back * lengths).sum()))
    return have


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes: one row per source (source, source_size). Adds target. Water level by distributed passes.

    Each pass sums over the sources that the level doesn't fill; the level rises until no further source is full.
    """
    spark = sizes.sparkSession
    ranked = (
        sizes.orderBy(F.col("source").isNull(), F.col("source"))
        .rdd.zipWithIndex()
        .map(lambda x: (x[0]["source"], int(x[0]["source_size"]), float(weights[x[1] % len(weights)])))
    )
    table = materialize(spark.createDataFrame(ranked, "source string, source_size long, weight double"), "source-weights")
    cap = F.col("source_size") * F.lit(float(most))
    level, full = 0.0, -1
    total = table.agg(F.sum("source_size")).first()[0] or 0
    while True:
        got = table.select(
            (cap < F.col("weight") * F.lit(level)).alias("full"), "weight", cap.alias("cap")
        ).agg(
            F.count_if("full").alias("n"),
            F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).alias("held"),
            F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0.0)).alias("open"),
        ).first()
        if got["n"] is None or not got["open"] or got["n"] == full:
            break
        full = got["n"]
        level = (share * total - got["held"]) / got["open"]
    return table.select("source", "source_size", F.least(cap, F.col("weight") * F.lit(level)).alias("target"))


def mix(docs: DataFrame, seed: int = 17, weights=WEIGHTS, share: float = SHARE, most: float = MOST, window: int = WINDOW, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, source, text_hash, size, source_size, target, taken of every document.

    Null or empty text: size 0, taken 0. Null source: a source of its own, last in the order. Repeated rows: each
    counts; very long texts: all their words; equal rows share the hash, the order among them is by doc_id and then arbitrary between identical rows.
    Empty table: no rows. Other columns of docs are ignored.
    """
    hashed = F.xxhash64(F.lit(seed), F.col("doc_id"))
    base = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"))
    base = materialize(base.withColumn("h", hashed), "mix-sizes")
    lengths = materialize(base.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-lengths")
    # as many buckets (a power of two) as the largest group needs, however many rows share a source and a length
    largest = lengths.agg(F.max("n")).first()[0] or 0
    bits = max(1, int(buckets).bit_length() - 1, (largest // BUCKET_ROWS).bit_length())
    base = base.withColumn("bucket", F.shiftrightunsigned("h", 64 - bits).cast("int"))
    goal = targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most)

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", kind="stable").reset_index(drop=True)
        size, n = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        total, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        have = copies_by_length(size, n, min(int(target), most * total), most, window)
        return pdf.assign(copies=have // n, more=have % n)[["source", "size", "source_size", "target", "copies", "more"]]

    joined = lengths.join(F.broadcast(goal) if goal.count() <= 10_000 else goal, lengths["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    quota = joined.groupBy("source").applyInPandas(plan, "source string, size long, source_size long, target double, copies int, more long")

    # documents before a hash bucket, among those of the same source and length
    by_bucket = base.groupBy("source", "size", "bucket").agg(F.count("*").alias("n"))
    run = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = by_bucket.withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0)))
    q = quota.select(F.col("source").alias("q_source"), F.col("size").alias("q_size"), "source_size", "target", "copies", "more")
    rule = before.join(q, before["source"].eqNullSafe(q["q_source"]) & (before["size"] == q["q_size"])).select(
        F.col("source").alias("q_source"), F.col("size").alias("q_size"), F.col("bucket").alias("q_bucket"), "before", "source_size", "target", "copies", "more"
    )
    rows = base.join(rule, base["source"].eqNullSafe(rule["q_source"]) & (base["size"] == rule["q_size"]) & (base["bucket"] == rule["q_bucket"]))
    rank = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("h", "doc_id"))
    extra = (rank + F.col("before") <= F.col("more")).cast("int")
    return rows.withColumn("extra", extra).select("doc_id", "source", "text_hash", "size", "source_size", "target", (F.col("size") * (F.col("copies") + F.col("extra"))).alias("taken"))


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all their columns, as often as the mix takes each (not at all, once or more).

    Documents without words take no part; other columns may have any name. Empty table: no rows. Equal rows (doc_id, source, text) are numbered on both sides, so that
    each gets its own number of copies.
    """
    plan = mix(docs, **options).filter("taken > 0").select("doc_id", "source", "text_hash", (F.col("taken") / F.col("size")).cast("int").alias("copies"))
    same = Window.partitionBy("p_id", "p_source", "p_hash")
    plan = plan.select(F.col("doc_id").alias("p_id"), F.col("source").alias("p_source"), F.col("text_hash").alias("p_hash"), "copies")
    plan = plan.withColumn("p_no", F.row_number().over(same.orderBy(F.desc("copies"))))
    # the row is one column while names of our own stand beside it
    rows = docs.select(F.struct("*").alias("row")).select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.source").cast("string").alias("source"), F.xxhash64("row.text").alias("h"))
    rows = rows.withColumn("no", F.row_number().over(Window.partitionBy("doc_id", "source", "h").orderBy("h")))
    match = F.col("doc_id").eqNullSafe(F.col("p_id")) & F.col("source").eqNullSafe(F.col("p_source")) & (F.col("h") == F.col("p_hash")) & (F.col("no") == F.col("p_no"))
    return rows.join(plan, match).select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
