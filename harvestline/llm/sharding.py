"""Extendible hashing of rows into shards that fit a byte limit.

The directory is indexed by the leading bits of a hash. All rows start in one bucket; only a
bucket over the limit is split on its next bit, until every bucket fits. Sizes of every
prefix come from one aggregated table, so a level of splits reads counters, not rows.

The hash has 128 bits: the first 64 of the MD5 of the key, then 64 of a row number, so rows
that repeat one key, however many, still split. A row that is larger than the limit gets a
bucket of its own.

Defined cases: a null key hashes like the empty string; null text has no bytes; no rows
give no shards. Columns may have any name: a clash only lengthens the folders' own name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from harvestline.llm.support import Scratch, table

LIMIT_BYTES = 64 << 20
STEP_BITS = 12           # levels of splits decided from one table of counters
HASH_BITS = 128


def hash_bits(key: Column, number: Column) -> Column:
    """128 bits as text: the key's, then the row number's."""
    def bits(value: Column) -> Column:
        digest = F.md5(F.coalesce(value.cast("string"), F.lit("")))
        half = [F.lpad(F.conv(F.substring(digest, at, 8), 16, 2), 32, "0") for at in (1, 9)]
        return F.concat(*half)
    return F.concat(bits(key), bits(number))


def directory(rows: DataFrame, limit: int, scratch: Scratch) -> DataFrame:
    """Final buckets (prefix, depth, bytes, n_rows) over rows (bits, bytes).

    Levels are decided `STEP_BITS` at a time; only rows of buckets that are still too large
    are counted again at the next levels.
    """
    done, open_rows, base = None, rows.withColumn("_open", F.lit("")), 0
    while True:
        top = min(base + STEP_BITS, HASH_BITS)
        leaves = scratch.write(open_rows.groupBy(F.substring("bits", 1, top).alias("leaf")).agg(
            F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n_rows")), f"leaves-{top}")
        levels = leaves.select("*", F.explode(F.sequence(F.lit(base), F.lit(top))).alias("depth")).groupBy(
            "depth", F.expr("substring(leaf, 1, depth)").alias("prefix")).agg(
            F.sum("bytes").alias("bytes"), F.sum("n_rows").alias("n_rows"))
        fits = (F.col("bytes") <= limit) | (F.col("n_rows") == 1)
        if top == HASH_BITS:
            fits = fits | (F.col("depth") == top)
        # the shallowest fitting level of each leaf is its bucket
        choice = (leaves.select("leaf", F.explode(F.sequence(F.lit(base), F.lit(top))).alias("depth"))
                  .withColumn("prefix", F.expr("substring(leaf, 1, depth)"))
                  .join(levels.where(fits).select("prefix", "depth", "bytes", "n_rows"), ["prefix", "depth"])
                  .groupBy("leaf").agg(F.min_by(F.struct("prefix", "depth", "bytes", "n_rows"), "depth").alias("b")))
        choice = scratch.write(choice, f"choice-{top}")
        found = choice.select("b.*").distinct()
        done = found if done is None else done.unionByName(found)
        rest = leaves.join(choice, "leaf", "left_anti").select("leaf")
        if top == HASH_BITS or rest.isEmpty():
            return done
        open_rows = open_rows.join(rest.withColumnRenamed("leaf", "_leaf"),
                                   F.substring("bits", 1, top) == F.col("_leaf")).drop("_leaf")
        base = top + 1


def _placed(rows: DataFrame, limit: int, scratch: Scratch) -> DataFrame:
    """Adds prefix, depth, shard_bytes and n_rows of its bucket to every row (bits, bytes, ...).

    Rows find their bucket by joining on the hash prefix at each depth that occurs: a few
    depths around the logarithm of the number of shards.
    """
    buckets = scratch.write(directory(rows.select("bits", "bytes"), limit, scratch).withColumnRenamed(
        "bytes", "shard_bytes"), "directory")
    depths = [r[0] for r in buckets.select("depth").distinct().collect()]  # at most 129 numbers
    if not depths:
        depths = [0]
    probes = rows.select("*", F.explode(F.array(*[
        F.struct(F.lit(d).alias("depth"), F.substring("bits", 1, d).alias("prefix")) for d in depths])).alias("p"))
    return probes.select(*rows.columns, "p.depth", "p.prefix").join(buckets, ["depth", "prefix"])


def _numbered(docs: DataFrame, key: str, text: str, *carried: Column) -> DataFrame:
    """(bytes, bits, *carried) of every row. Row numbers change when evaluated again: write it once."""
    return docs.select(F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"),
                       hash_bits(F.col(key), F.monotonically_increasing_id()).alias("bits"), *carried)


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text",
           limit: int = LIMIT_BYTES) -> DataFrame:
    """Adds shard, depth and shard_bytes to (key, bytes) of every row."""
    scratch = Scratch(docs.sparkSession, "sharding")
    rows = scratch.write(_numbered(docs, key, text, F.col(key).alias("key")), "rows")
    return _placed(rows, limit, scratch).select(
        F.col("key").alias(key), "bytes", F.col("prefix").alias("shard"),
        F.col("depth").cast("int").alias("depth"), "shard_bytes", F.col("n_rows").alias("shard_rows"))


def folder_column(names: list[str]) -> str:
    """The column that names folders: `shard`, lengthened until no column of the rows has its name."""
    taken, name = {n.lower() for n in names}, "shard"
    while name in taken:
        name += "_"
    return name


def write_shards(docs: DataFrame, target: str, key: str = "doc_id", text: str = "text",
                 limit: int = LIMIT_BYTES) -> None:
    """Write the rows of `docs` as one folder per shard. Keys may repeat or be null.

    Whole rows pass the directory join with their own hash bits, so each is written once.
    """
    scratch = Scratch(docs.sparkSession, "sharding")
    folder = folder_column(docs.columns)
    numbered = _numbered(docs, key, text, F.struct(*docs.columns).alias("row"))
    # texts are on disk twice and in the shuffle once: a denser codec than the default pays
    numbered.write.option("compression", "zstd").parquet(scratch.path("rows"))
    rows = scratch.read("rows", numbered)
    (_placed(rows, limit, scratch).select("row.*", F.concat(F.lit("b"), "prefix").alias(folder))
     .repartition(folder).write.option("compression", "zstd").partitionBy(folder).parquet(target))
    scratch.drop("rows")


def read_shards(spark: SparkSession, target: str, schema: StructType) -> DataFrame:
    """Rows of written shards with their shard in `folder_column`, the last column."""
    folder = folder_column(schema.names)
    held = StructType([*schema.fields, StructField(folder, StringType())])
    return spark.read.schema(held).parquet(target).withColumn(folder, F.expr(f"substring({folder}, 2)"))


def digest(shards: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of `assign`, taken from rows read back."""
    rows = shards.select(key, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"),
                         F.col(shards.columns[-1]).alias("shard"))
    sizes = rows.groupBy("shard").agg(F.sum("bytes").alias("shard_bytes"), F.count(F.lit(1)).alias("shard_rows"))
    return rows.join(sizes, "shard").select(
        key, "bytes", "shard", F.length("shard").alias("depth"), "shard_bytes", "shard_rows")


def query(spark, sf_dir):
    """Write the shards; everything returned is read from their files."""
    docs = table(spark, sf_dir, "documents")
    target = Scratch(spark, "shards").path("shards")
    write_shards(docs, target)
    return digest(read_shards(spark, target, docs.schema))


SQL = f"""
WITH hashed AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes,
         array_to_string(list_transform(range(1, 17), lambda i: lpad(bin(instr('0123456789abcdef',
           substr(md5(coalesce(doc_id::VARCHAR, '')), i::INT, 1)) - 1), 4, '0')), '') AS bits
  FROM documents
), levels AS (
  SELECT depth, left(bits, depth) AS prefix, sum(bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows
  FROM hashed CROSS JOIN (SELECT unnest(range(0, 33))::INT AS depth) GROUP BY ALL
), fits AS (SELECT * FROM levels WHERE shard_bytes <= {LIMIT_BYTES} OR shard_rows = 1)
SELECT h.doc_id, h.bytes, f.prefix AS shard, f.depth, f.shard_bytes, f.shard_rows
FROM hashed h JOIN fits f ON left(h.bits, f.depth) = f.prefix
WHERE NOT EXISTS (SELECT 1 FROM fits g WHERE g.depth < f.depth AND left(h.bits, g.depth) = g.prefix)
"""
