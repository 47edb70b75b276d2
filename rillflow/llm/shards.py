"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash within their source; the k-th of a source's n rows gets the fractional rank
(k + 0.5) / n; all rows are ordered by fractional rank and cut into equal runs. Every run then holds each source in the
proportion it has in the whole, and shard sizes differ by one row at most (law ``rows``).

No source is ever sorted in one task. Ranks within a source come from buckets of the seeded hash, and positions from
buckets of the fractional rank: both are uniform by construction, whatever share one source has. Bucket offsets are prefix
sums on two levels, over the buckets of a run of RUN_BUCKETS and over the runs, so the one task that sums up a source (or the
whole) sees a row for each BUCKET_ROWS * RUN_BUCKETS rows. Texts are read once and are not moved: their sizes and checksums,
numbered row by row, are written to the shared folder, so every later step sees the same rows, also after a lost executor.

Defined results: a null source is a source of its own; null texts have size 1 and the checksum of nothing; the hash covers
the row's number too, so rows that repeat an id, or have none, are spread like any others; an empty table gives no rows.
Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

N_SHARDS, SEED = 16, 20_240_607
#: Rows that a bucket holds on average, and buckets of a run.
BUCKET_ROWS, RUN_BUCKETS = 1024, 1024


def _ranked(df: DataFrame, keys: list[str], bucket: str, order: list[str], to: str) -> DataFrame:
    """to: position of a row, from 0, in the order (bucket, *order) of its keys' rows."""
    counts = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_n")).withColumn("_run", F.floor(F.col(bucket) / RUN_BUCKETS))
    runs = counts.groupBy(*keys, "_run").agg(F.sum("_n").alias("_rows_of"))
    ahead = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    summed = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    names = [*keys, "_run"]
    first = runs.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(names)], summed("_rows_of", ahead(*keys).orderBy("_run")).alias("_first"))
    within = counts.withColumn("_in", summed("_n", ahead(*names).orderBy(bucket)))
    on_run = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_r{i}")) for i, k in enumerate(names)])
    offsets = within.join(first, on_run).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, bucket])], (F.col("_first") + F.col("_in")).alias("_before"))
    inner = df.withColumn("_at", F.row_number().over(Window.partitionBy(*keys, bucket).orderBy(*order)) - 1)
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate([*keys, bucket])])
    return inner.join(offsets, on).withColumn(to, F.col("_before") + F.col("_at")).drop("_at", "_before", *[f"_k{i}" for i in range(len(keys) + 1)])


def assign(docs: DataFrame, n_shards: int = N_SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, text_crc32, shard, slot."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("_row"))
    rows = written(rows, "shard-rows")
    total = rows.count()
    n_buckets = max(1, total // BUCKET_ROWS)
    hashed = rows.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "_row"))
    per_source = hashed.groupBy(F.col("source").alias("_s")).agg(F.count(F.lit(1)).alias("_rows"))
    sized = hashed.join(per_source, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    # about BUCKET_ROWS rows in each of a source's buckets: the hash's upper bits, cut into as many runs as the source needs
    wide = F.greatest(F.lit(1), F.floor(F.col("_rows") / BUCKET_ROWS))
    # a bucket is the share of the hash's range below the row's hash, so buckets are in the hash's order
    share = (F.shiftrightunsigned("_h", 24).cast("double")) / float(1 << 40)
    bucketed = sized.withColumn("_b", F.floor(share * wide))
    # written, as both the counts and the rows of the next order come from it
    ranked = written(_ranked(bucketed, ["source"], "_b", ["_h", "_row"], "_rank").drop("_b", "_h"), "shard-ranks")
    placed = ranked.withColumn("_f", (F.col("_rank") + 0.5) / F.col("_rows")).withColumn("_g", F.floor(F.col("_f") * F.lit(n_buckets))).withColumn("_all", F.lit(0))
    global_rank = _ranked(placed, ["_all"], "_g", ["_f", "source", "_rank"], "_p")
    shard = F.floor(F.col("_p") * n_shards / F.lit(max(1, total)))
    # the first position of shard s is the least p with floor(p * n / total) = s
    first = F.ceil(shard * F.lit(total) / F.lit(n_shards))
    return global_rank.select("doc_id", "source", "size", "text_crc32", shard.cast("int").alias("shard"), (F.col("_p") - first).cast("long").alias("slot"))


def op8_shard_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
