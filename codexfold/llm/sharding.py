"""A uniform shuffle into shards of exact sizes by a communication matrix.

Rows lie in blocks. How many rows of each block go to each shard is drawn exactly
as in a uniform random permutation: block by block from the multivariate
hypergeometric law over the places still free. Then every block is permuted
locally and dealt out by its line of the matrix, and every shard is permuted
again. Shard sizes differ by one row at most. Everything but the draw of the
matrix, which is numbers per (block, shard) and no data, is DataFrame expressions.
"""

from __future__ import annotations

import random
from math import exp, lgamma

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexfold.llm.common import written


def _hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Good ones among ``draws`` of ``good + bad`` places, by inversion from the mode outwards."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    def log_choose(n: int, k: int) -> float:
        return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)

    total = log_choose(good + bad, draws)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    p = exp(log_choose(good, mode) + log_choose(bad, draws - mode) - total)
    left = rng.random() - p
    up, p_up, down, p_down = mode, p, mode, p
    while left > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
        if p_up == 0 and p_down == 0:
            break
    return mode


def communication_matrix(block_rows: list[int], shard_rows: list[int], seed: int) -> list[list[int]]:
    """Rows from each block (line) to each shard (column); sums are as given."""
    rng = random.Random(seed)
    free, matrix = list(shard_rows), []
    for rows in block_rows:
        line, places = [], sum(free)
        for j, f in enumerate(free):
            take = _hypergeometric(rng, f, places - f, rows)
            line.append(take)
            places -= f
            rows -= take
        matrix.append(line)
        free = [f - t for f, t in zip(free, line)]
    return matrix


def uniform_shards(docs: DataFrame, shards: int = 40, seed: int = 0, row_key: list[str] | None = None, block_rows: int = 100_000, blocks: tuple[int, int] = (256, 4096)) -> DataFrame:
    """``docs`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    A row's block and its places in the permutations follow from a keyed hash of
    ``row_key`` (default: all columns), so a lost task gives the same rows again; equal
    rows are interchangeable. Columns named shard or slot are replaced. Nulls count as
    values, an empty table stays empty; texts need not be part of the key. The matrix has
    as many lines as there are blocks, within the bounds ``blocks``.
    """
    columns = [c for c in docs.columns if c not in ("shard", "slot")]
    key = [F.col(c) for c in (row_key or columns)]
    hashed = lambda salt: F.xxhash64(F.lit(f"{salt}-{seed}"), *key)
    n = docs.count()
    blocks = min(max(blocks[0], -(-n // block_rows)), blocks[1])  # lines of the matrix, so bounded
    block: Column = F.pmod(hashed("block"), F.lit(blocks)).cast("int")
    counts = {r.b: r.n for r in docs.groupBy(block.alias("b")).agg(F.count("*").alias("n")).collect()}  # one number per block
    lines = communication_matrix([counts.get(b, 0) for b in range(blocks)], [n // shards + (j < n % shards) for j in range(shards)], seed)

    # line b as the running sums of its columns: the r-th row of the block goes to the first shard whose sum is above r
    ends = []
    for line in lines:
        total, sums = 0, []
        for take in line:
            total += take
            sums.append(total)
        ends.append("[" + ",".join(map(str, sums)) + "]")
    spark = docs.sparkSession
    text = "[" + ",".join(ends) + "]"
    matrix = written(spark.range(1).select(F.posexplode(F.from_json(F.lit(text), "array<array<bigint>>")).alias("_block", "_ends")))

    local = Window.partitionBy("_block").orderBy(hashed("local"))
    dealt = (
        docs.select(columns).withColumn("_block", block).withColumn("_r", F.row_number().over(local) - 1)
        .join(matrix, "_block").withColumn("shard", F.size(F.filter("_ends", lambda e: e <= F.col("_r"))).cast("int"))
        .drop("_block", "_r", "_ends")
    )
    # the second permutation orders by a hash; its leading bits cut a shard into parts that are numbered apart
    parts = max(8, -(-n // (shards * block_rows)))
    dealt = written(dealt.withColumn("_h", hashed("place")).withColumn("_part", F.floor((F.shiftright("_h", 1) / F.lit(2.0**63) + 0.5) * parts).cast("int")))
    sums = dealt.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    first = written(sums.select("shard", "_part", F.coalesce(before, F.lit(0)).alias("_first")))
    within = F.row_number().over(Window.partitionBy("shard", "_part").orderBy("_h")) - 1
    return dealt.withColumn("_w", within).join(first, ["shard", "_part"]).select(*columns, "shard", (F.col("_first") + F.col("_w")).alias("slot"))
