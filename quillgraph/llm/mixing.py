"""Mixing sources to target weights by fitting a subset sum to each budget.

Documents are counted by exact size.  Every source first takes whole passes over
all its documents and, of each size, the same share of what is left; the
remaining budget is filled by bounded-knapsack dynamic programming over (size,
count).  The plan says how many documents of each size to take; which ones is
decided by a seeded hash.  Only the histogram meets in one task: it has as many
rows as there are distinct sizes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from quillgraph.llm.textkit import spread, word_count
from quillgraph.operators.communities import ordered_index
from quillgraph.session import materialise

# Weights by the source's rank, the share of all sizes, most copies.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2

#: Budget up to which the dynamic programme is solved exactly; greedy passes come before.
DP_BUDGET = 1 << 16

#: Ranges of the seeded hash by which a size class is cut before its rows are ranked.
RANGES = 4096


def fit(sizes: np.ndarray, counts: np.ndarray, budget: float) -> np.ndarray:
    """How many of each size to take, at most ``counts``, so that their sum comes nearest below ``budget``.

    A proportional part, one less of each size, keeps the mixture of sizes; largest sizes
    then fill what is left down to ``DP_BUDGET``, and a bounded knapsack the rest.
    """
    take = np.zeros(len(sizes), dtype=np.int64)
    total = float((sizes * counts).sum())
    if total <= 0 or budget <= 0:
        return take
    if budget >= total:
        return counts.astype(np.int64).copy()
    take = np.maximum(np.floor(counts * (budget / total)).astype(np.int64) - 1, 0)
    rest = int(budget) - int((take * sizes).sum())
    for i in np.argsort(-sizes, kind="stable"):
        if rest <= DP_BUDGET:
            break
        more = min(int(counts[i] - take[i]), (rest - DP_BUDGET) // int(sizes[i]) + 1 if sizes[i] else 0, rest // max(int(sizes[i]), 1))
        take[i] += more
        rest -= more * int(sizes[i])
    return take + _knapsack(sizes, counts - take, max(rest, 0))


def _knapsack(sizes: np.ndarray, free: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack: reach the largest sum up to ``budget``.

    ``reached`` has a bit for each sum.  Counts are cut into powers of two, and each
    sum remembers the first bundle that reached it.
    """
    out, reached, full = np.zeros(len(sizes), dtype=np.int64), 1, (1 << (budget + 1)) - 1
    bundle = np.full(budget + 1, -1, dtype=np.int32)
    bundles: list[tuple[int, int]] = []
    for i in range(len(sizes)):
        size, left, power = int(sizes[i]), int(free[i]), 1
        while size and left and power * size <= budget:
            many = min(power, left)
            left, power = left - many, power * 2
            if many * size > budget:
                break
            new = (reached << (many * size)) & full & ~reached
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes(budget // 8 + 1, "little"), np.uint8), bitorder="little")
                bundle[np.flatnonzero(bits[: budget + 1])] = len(bundles)
                reached |= new
            bundles.append((i, many))
            if reached >> budget & 1:
                left = 0
        if reached >> budget & 1:
            break
    at = reached.bit_length() - 1
    while at > 0:
        i, many = bundles[bundle[at]]
        out[i] += many
        at -= many * int(sizes[i])
    return out


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
                   most: float = MOST) -> DataFrame:
    """Per source (null last): its size and its target, shared by weight and stopped at ``most`` times the size.

    The excess of stopped sources is shared again by weight among the others until
    none is above; only sums over the sources reach the driver.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = sums.withColumns({"_last": F.col("source").isNull().cast("int"), "_name": F.coalesce("source", F.lit("")), "_all": F.lit(0)})
    ranked = materialise(ordered_index(named, ["_all"], [F.col("_last"), F.col("_name")], "rank").select(
        "source", "source_size", F.get(F.array(*[F.lit(float(w)) for w in weights]), (
            F.col("rank") % len(weights)).cast("int")).alias("_weight")))
    cap = most * F.col("source_size").cast("double")
    total = float(ranked.select(F.coalesce(F.sum("source_size"), F.lit(0)).alias("x")).first()["x"])
    rate = -1.0
    while True:   # the rate only grows, so every round stops at least one more source
        stopped = F.col("_weight") * rate > cap if rate >= 0 else F.lit(False)
        sums = ranked.select(
            F.sum(F.when(stopped, cap).otherwise(0.0)).alias("full"),
            F.sum(F.when(stopped, 0.0).otherwise(F.col("_weight"))).alias("weight")).first()
        if not sums["weight"]:
            break
        new = (share * total - sums["full"]) / sums["weight"]
        if new <= rate:
            break
        rate = new
    return ranked.select("source", "source_size", F.least(F.lit(max(rate, 0.0)) * F.col("_weight"), cap).alias("target"))


def _plan_group(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("size", kind="stable")
    sizes, counts = rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    whole, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
    passes = int(min(target // whole, MOST)) if whole else 1
    extra = fit(sizes, counts, target - passes * whole) if passes < MOST else np.zeros(len(sizes), np.int64)
    return pd.DataFrame({"_no": rows["_no"], "size": sizes, "n": counts, "passes": passes, "extra": extra})


def mix(docs: DataFrame, seed: int = 7, keep: tuple[str, ...] = (), weights: tuple[float, ...] = WEIGHTS,
        share: float = SHARE) -> DataFrame:
    """How often the mix takes each document: ``copies`` (0 to 2), with size, source_size, target and taken.

    Null texts have size 0; null sources form one source, the last.  Of a size class
    the documents with the smallest seeded hash of (doc_id, text) are taken, ties by
    doc_id and then any of the equal rows, so reruns agree.  Documents of size 0
    are taken once: they cost nothing.
    """
    sized = materialise(spread(docs).select(
        "doc_id", "source", *keep, word_count(F.col("text")).alias("size"),
        F.xxhash64(F.lit(seed), "doc_id", "text").alias("_h")))
    targets = materialise(source_targets(sized, weights, share).withColumn(
        "_no", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull())))
    number = F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull()).alias("_no")
    histogram = sized.groupBy(number, "size").agg(F.count("*").alias("n"))
    plan = materialise(histogram.join(targets.select("_no", "source_size", "target"), "_no").groupBy("_no").applyInPandas(
        _plan_group, "_no bigint, size bigint, n bigint, passes int, extra bigint"))

    # Cut each size class by ranges of the hash; only the range in which its count runs out is ranked.
    lane = F.pmod(F.col("_h"), F.lit(RANGES)).alias("_lane")
    placed = sized.select("*", number, lane)
    lanes = placed.groupBy("_no", "size", "_lane").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy("_no", "size").orderBy("_lane").rowsBetween(Window.unboundedPreceding, -1)
    cut = lanes.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).join(
        plan.select("_no", "size", "passes", "extra"), ["_no", "size"]).withColumn(
        "_left", F.col("extra") - F.col("_before")).select("_no", "size", "_lane", "passes", "_left", "_rows")
    known = placed.join(cut, ["_no", "size", "_lane"])
    whole = known.filter((F.col("_left") <= 0) | (F.col("_left") >= F.col("_rows"))).withColumn(
        "_more", (F.col("_left") > 0).cast("int"))
    order = Window.partitionBy("_no", "size", "_lane").orderBy("_h", "doc_id")
    split = known.filter((F.col("_left") > 0) & (F.col("_left") < F.col("_rows"))).withColumn(
        "_more", (F.row_number().over(order) <= F.col("_left")).cast("int"))
    taken = whole.unionByName(split)
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("passes") + F.col("_more"))
    return taken.join(targets.select("_no", "source_size", "target"), "_no").select(
        "doc_id", "source", *keep, "size", "source_size", "target", copies.cast("int").alias("copies"),
        (copies * F.col("size")).cast("long").alias("taken"))


def resample(docs: DataFrame, seed: int = 7, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """The rows of the mix, with all columns: each row as often as :func:`mix` takes it.

    Rows that are equal in all columns are counted together and written so many times.
    """
    key = [F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_k"), F.xxhash64(
        F.lit(1), *docs.columns, *[F.col(c).isNull() for c in docs.columns]).alias("_r")]
    keyed = docs.select("*", *key)
    counted = mix(keyed, seed, ("_k", "_r"), weights, share).groupBy("_k", "_r").agg(F.sum("copies").alias("_times")).filter("_times > 0")
    once = keyed.dropDuplicates(["_k", "_r"]).join(counted, ["_k", "_r"])
    # Two steps, so that a row of very many copies needs no long array.
    blocks = once.withColumn("_block", F.explode(F.sequence(F.lit(0), F.call_function("div", F.col("_times") - 1, F.lit(1000)))))
    left = F.least(F.col("_times") - 1000 * F.col("_block"), F.lit(1000))
    return blocks.withColumn("_copy", F.explode(F.sequence(F.lit(1), left.cast("int")))).select(*docs.columns)
