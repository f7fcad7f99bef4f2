"""Two-pass external shuffle into shards, in DataFrame operations alone.

Pass one scatters whole records uniformly into buckets of bounded size by a seeded hash of their content and of their row's number
in the input; Spark's exchange writes them to disk. Pass two takes one bucket at a time into memory, puts it into
an order of its own content, permutes it by Fisher-Yates (what Spark's `shuffle` does to an array) and writes it; a task takes its buckets in their order, so that the
seed and the input fix the permutation. A record's
place in the whole is the rows of the buckets before plus its place in its bucket; place p goes to shard p mod n, slot p div n,
so that the shards' row counts differ by one at most. The rows before a bucket are added up within blocks of BLOCK buckets, then over the blocks.

Defined cases: null text counts as no bytes; null doc_ids are records as any other; repeated rows stay apart and are scattered one by one, wherever they stand,
so no group of copies fills a bucket beyond its share; rows of equal content in one bucket are permuted as any others; a text longer than a bucket is a record in a bucket
of about its size; an empty table gives no rows; all columns are kept inside `record`, so that names can't clash, whatever letters they hold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.common import column, documents, table, whole

#: Bytes of text in a bucket. Pass two holds a few copies of one.
BUCKET_BYTES = 8 << 20
#: Up to so many buckets, the rows before each are broadcast (3 MB).
BROADCAST_BUCKETS = 200_000
#: Buckets whose rows one task adds up.
BLOCK = 10_000


def text_bytes(text: str) -> Column:
    return F.coalesce(F.octet_length(column(text).cast("string")), F.lit(0)).cast("long") + 1


def shuffle_into_shards(docs: DataFrame, shards: int = 8, seed: int = 20240229, bucket_bytes: int = BUCKET_BYTES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """record (struct of all columns), size, bucket, shard, slot. The buckets are written to the shared folder in their new order."""
    total = docs.agg(F.coalesce(F.sum(text_bytes(text)), F.lit(0))).first()[0]
    buckets = max(1, math.ceil(total / bucket_bytes))
    content = F.xxhash64(F.lit(seed), column(doc_id), column(text))
    rows = docs.select(F.xxhash64(F.lit(seed + 1), column(doc_id), column(text), F.monotonically_increasing_id()).alias("scatter"), content.alias("content"), text_bytes(text).alias("size"), whole(docs).alias("record"))
    scattered = rows.withColumn("bucket", F.pmod("scatter", F.lit(buckets))).repartition(buckets, "bucket")
    held = scattered.groupBy("bucket").agg(F.collect_list(F.struct("content", "size", "record")).alias("rows")).sortWithinPartitions("bucket")
    ordered = F.array_sort("rows", lambda a, b: F.when(a["content"] < b["content"], -1).when(a["content"] > b["content"], 1).otherwise(0))
    mixed = held.select("bucket", F.posexplode(F.shuffle(ordered, F.lit(seed))).alias("place", "row"))
    written = table(mixed.select("bucket", "place", "row.size", "row.record"), "shards")
    counts = written.groupBy("bucket").agg((F.max("place") + 1).cast("long").alias("rows")).withColumn("block", F.floor(F.col("bucket") / BLOCK))
    blocks = counts.groupBy("block").agg(F.sum("rows").alias("rows")).select("block", (F.sum("rows").over(Window.orderBy("block")) - F.col("rows")).alias("earlier"))  # a row for BLOCK buckets
    inside = F.sum("rows").over(Window.partitionBy("block").orderBy("bucket")) - F.col("rows")
    before = counts.withColumn("inside", inside).join(F.broadcast(blocks), "block").select("bucket", (F.col("earlier") + F.col("inside")).alias("before"))
    if buckets <= BROADCAST_BUCKETS:  # 16 bytes a bucket; beyond that the join shuffles
        before = F.broadcast(before)
    place = F.col("before") + F.col("place")
    return written.join(before, "bucket").select("record", "size", "bucket", (place % shards).cast("int").alias("shard"), F.floor(place / shards).cast("long").alias("slot"))


def write_shards(placed: DataFrame, folder: str) -> None:
    """Writes a folder of Parquet files for each shard (shard=0, shard=1, ...), its rows in order of slot within each file."""
    placed.select("record.*", F.col("slot").alias("__slot"), F.col("shard").alias("__shard")).repartition("__shard", F.floor(F.col("__slot") / 1_000_000)).sortWithinPartitions("__shard", "__slot").write.partitionBy("__shard").parquet(folder)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 by the law `rows`; sizes and checksums come from the records as written."""
    placed = shuffle_into_shards(documents(spark, sf_dir))
    crc = F.crc32(F.coalesce(F.col("record.text"), F.lit("")).cast("binary"))
    return placed.select("record.doc_id", "size", crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
