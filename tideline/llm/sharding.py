"""Sharding by extendible hashing: every shard fits a byte limit, and only oversized buckets split.

A document's key is hashed to 64 bits; a shard is a hash prefix. Starting from the least number of bits that could do, the directory has
an entry for each prefix of its global depth; a bucket over the limit splits on its next bit, and entries of a smaller
bucket share it. Bucket sizes come from one aggregation of the documents by the directory's prefix; only the rows of
buckets that are still too large go to a deeper directory. Rows whose hashes are wholly equal (repeated rows) can't be told
apart by bits: their bucket overflows into numbered chunks; a single row over the limit has a chunk of its own.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import shared_dir, table, written

LIMIT = 16 << 20
#: Bits that a directory adds to the least that could do, and the most it has (4 million entries).
SLACK, MOST_BITS = 4, 22


def _prefix(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("long")


def _directory(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """cell, depth of each entry: the bucket's depth, or null where bits up to high don't do. cells(cell, bytes) at depth high."""
    # A cell's bucket is its shortest prefix, of low bits at least, that fits: sizes of all prefixes, by one row a cell and depth.
    depths = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
    prefix = F.expr(f"shiftrightunsigned(cell, {high} - depth)")
    sizes = depths.groupBy("depth", prefix.alias("prefix")).agg(F.sum("bytes").alias("shard_bytes")).filter(F.col("shard_bytes") <= limit)
    fits = depths.withColumn("prefix", prefix).join(sizes, ["depth", "prefix"])
    return fits.groupBy("cell").agg(F.min(F.struct("depth", "shard_bytes")).alias("b")).select("cell", "b.depth", "b.shard_bytes")


def _bits(h: Column, n: Column) -> Column:
    """The first n bits of a long, as text."""
    return F.substring(F.lpad(F.conv(h.cast("string"), 10, 2), 64, "0"), F.lit(1), n)


def _hashed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    return docs.withColumn("__bytes", size).withColumn("__h", F.xxhash64("doc_id", text))


def _placed(docs: DataFrame, limit: int) -> DataFrame:
    """Every row of docs, all its columns, with __bytes, __shard, __depth, __shard_bytes and __oversized."""
    todo = written(_hashed(docs).select("__h", "__bytes"), "shards-rows")
    total = todo.agg(F.sum("__bytes")).first()[0] or 0
    low, directories = 0, []
    high = min(MOST_BITS, max(1, math.ceil(math.log2(max(1, total / limit)))) + SLACK)
    while True:
        keyed = todo.withColumn("cell", _prefix(F.col("__h"), high))
        directory = written(_directory(keyed.groupBy("cell").agg(F.sum("__bytes").alias("bytes")), low, high, limit), "shards-directory")
        directories.append((high, directory.toDF("__cell", "__depth", "__shard_bytes")))
        if high == 64:
            break
        todo = written(keyed.join(directory, "cell", "left_anti").select("__h", "__bytes"), "shards-rows")
        if todo.isEmpty():
            break
        low, high = high + 1, min(64, high + MOST_BITS)
    # The rows themselves pass the directories in turn; what none has overflows.
    columns = [F.col(f"`{c}`") for c in docs.columns]
    done, left = None, _hashed(docs).withColumn("__part", F.spark_partition_id())
    for bits, directory in directories:
        met = left.withColumn("__cell", _prefix(F.col("__h"), bits)).join(directory, "__cell", "left")
        fit = met.filter("__depth IS NOT NULL").select(*columns, "__bytes", _bits(F.col("__h"), F.col("__depth")).alias("__shard"), "__depth", "__shard_bytes", F.lit(False).alias("__oversized"))
        done = fit if done is None else done.unionByName(fit)
        left = met.filter("__depth IS NULL").select(*columns, "__bytes", "__h", "__part")
    if high < 64:
        return done
    # Equal hashes, over the limit together: equal rows, of equal size. Chunks are counted within the input's partitions.
    # Which row has which number is open, so it is fixed by writing.
    window = Window.partitionBy("__h", "__part").orderBy("__bytes")
    per = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("__bytes", F.lit(1))))
    chunks = written(left.withColumn("__chunk", F.floor((F.row_number().over(window) - 1) / per)), "shards-overflow")
    shard = F.concat(_bits(F.col("__h"), F.lit(64)), F.lit("/"), F.col("__part"), F.lit("."), F.col("__chunk"))
    sized = chunks.withColumn("__shard_bytes", F.sum("__bytes").over(Window.partitionBy("__h", "__part", "__chunk")))
    return done.unionByName(sized.select(*columns, "__bytes", shard.alias("__shard"), F.lit(64).alias("__depth"), "__shard_bytes", (F.col("__bytes") > limit).alias("__oversized")))


ASSIGNMENT = ("doc_bytes", "shard", "shard_depth", "shard_bytes", "oversized")


def shards(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, doc_bytes, shard, shard_depth, shard_bytes, oversized of every row of docs(doc_id, text, ...).

    shard is the prefix's bits ('' is the whole), with '/chunk' where equal hashes overflow. The bytes of a row are its text's
    in UTF-8 (null and empty: 0). The hash is of doc_id and text, so a null doc_id, or ids that repeat, are spread as
    well; rows that repeat both share a shard, or overflow. Only a shard of one row larger than the limit is oversized. No rows give
    no rows; other columns are not looked at.
    """
    return _placed(docs.select("doc_id", "text"), limit).select("doc_id", *(F.col(f"__{c}").alias(o) for c, o in zip(("bytes", "shard", "depth", "shard_bytes", "oversized"), ASSIGNMENT)))


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Writes each row of docs once under path, a folder a shard, and returns the assignment as read from the shards written.

    Null and repeated ids are rows like any other. Folders are named by column shard, which docs must not have.
    """
    if "shard" in (c.lower() for c in docs.columns):
        raise ValueError("docs has a column shard")
    placed = _placed(docs, limit).select(*(F.col(f"`{c}`") for c in docs.columns), F.col("__shard").alias("shard"))
    placed.repartition("shard").write.partitionBy("shard").parquet(path)
    # The schema is stated, since '0101' would be read as a number; '' is a null folder.
    schema = StructType([*docs.schema.fields, StructField("shard", StringType())])
    rows = docs.sparkSession.read.schema(schema).parquet(path)
    rows = _hashed(rows).select("doc_id", F.col("__bytes").alias("doc_bytes"), F.coalesce("shard", F.lit("")).alias("shard"))
    sizes = rows.groupBy("shard").agg(F.sum("doc_bytes").alias("shard_bytes"))
    depth = F.length(F.substring_index("shard", "/", 1))
    return rows.join(sizes, "shard").select("doc_id", "doc_bytes", "shard", depth.alias("shard_depth"), "shard_bytes", (F.col("shard_bytes") > limit).alias("oversized"))


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    """Documents are written to shards in the shared folder; the rows are read from these."""
    return write_shards(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")
