"""Operator 3, sharding: a Feistel permutation with cycle walking over global row numbers.

Rows get numbers 0 to n - 1; a keyed permutation of those numbers is the shuffle, and from a row's place p in it follow
shard p mod k and slot p div k. So counts of shards differ by one at most, slots have no gaps, and any row's place can be
computed from its number without looking at other rows. Only DataFrame and SQL functions run."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.llm.shared import written

#: Row numbers are counted per bucket of the order's hash; as many counts go to the driver, whatever the input.
BUCKETS = 4096
ROUNDS = 6
#: A walk outside 0 to n - 1 is longer than this with a probability under n ** -31 where the bound below doesn't rule it out.
WALK = 64


def domain(n: int) -> tuple[int, int]:
    """(a, b) with a * b the least product over n - 1 for a the root of n: fewer than a numbers lie outside 0 to n - 1."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def _permuted(x: str, n: int, key: int) -> str:
    """SQL for the place of row number x: rounds add a keyed hash of one half to the other, until the result is under n."""
    a, b = domain(n)

    def once(v: str) -> str:
        return (
            f"aggregate(sequence(0L, {ROUNDS - 1}L), named_struct('l', {v} div {b}L, 'r', pmod({v}, {b}L)), (s, i) -> if(i % 2 = 0, "
            f"named_struct('l', s.l, 'r', pmod(s.r + pmod(xxhash64({key}L, i, s.l), {b}L), {b}L)), "
            f"named_struct('l', pmod(s.l + pmod(xxhash64({key}L, i, s.r), {a}L), {a}L), 'r', s.r)), s -> s.l * {b}L + s.r)"
        )

    steps = min(a * b - n + 1, WALK)  # a walk visits each number outside at most once
    return f"aggregate(sequence(1, {steps}), {once(x)}, (v, j) -> if(v < {n}L, v, {once('v')}))"


def shard(rows: DataFrame, shards: int, order_by: list[str], key: int = 2_024) -> DataFrame:
    """rows with row_number, position, shard (int) and slot (long); columns of these names are replaced.

    order_by: columns of hashable types that fix the order of row numbers (by bucket of their hash, then by value, nulls
    first). Rows that agree in all of them are interchangeable: the set of their places is fixed, not which of them has
    which. The same rows, shards and key give the same result on any cluster. An empty table gives an empty result.
    Rows should be narrow, ids and sizes: they are shuffled once."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    bucketed = written(rows.withColumn("__bucket", F.pmod(F.xxhash64(*order_by), F.lit(BUCKETS)).cast("int")))
    counts = dict(bucketed.groupBy("__bucket").count().collect())  # at most BUCKETS rows
    n, before = 0, []
    for bucket in range(BUCKETS):
        before.append(n)
        n += counts.get(bucket, 0)
    within = Window.partitionBy("__bucket").orderBy(*(F.col(c).asc_nulls_first() for c in order_by))
    numbered = bucketed.withColumn("__rank", F.row_number().over(within).cast("long"))
    first = F.element_at(F.lit(before).cast("array<bigint>"), F.col("__bucket") + 1)
    placed = numbered.withColumn("row_number", first + F.col("__rank") - 1).withColumn("position", F.expr(_permuted("row_number", n, key)))
    out = placed.withColumn("position", F.when(F.col("position") < n, F.col("position")).otherwise(F.raise_error(F.lit("walk too long")).cast("bigint")))
    return out.withColumns({"shard": F.pmod("position", F.lit(shards)).cast("int"), "slot": F.expr(f"position div {shards}L")}).drop("__bucket", "__rank")


def document_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 8) and text_crc32 (unsigned) of each row; a null text has no bytes."""
    text = F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary")
    return docs.select(docs["doc_id"].alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law (`rows`), shard, slot, grown_shard (null: that is of another law)."""
    placed = shard(document_sizes(docs), shards, ["doc_id", "size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")
