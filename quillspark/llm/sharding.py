"""Operator 11: sharding by rendezvous hashing over weighted shards, in DataFrame functions only.

Every shard draws a number from (record key, shard) alone; a record goes to the shard whose draw, stretched by its weight, is
the greatest: weight / -ln(u), u uniform in (0, 1), gives each shard a share of the keys in proportion to its weight. As no
draw depends on the other shards, a further shard takes records only into itself, a removed one gives up only its own, and a
changed weight moves only what that shard wins or loses. The work for a row grows with the number of shards and needs no
shuffle. Slots number each shard's rows by doc_id from 0; they come from sorted ranges that are cut by the whole order, so
neither a large shard nor a common id is one task's work.

Defined results: the key is the doc_id, or the text's SHA-256 where there is none, so rows without an id spread too; rows that
repeat an id share its shard, whatever their texts; a null text has size 1 and the checksum of the empty text; a shard of
weight 0 gets nothing, and at least one weight must be above 0; an empty table gives an empty result. Inside a shard slots go
by doc_id (none first), checksum and size; rows equal in these differ in nothing but the slot. Texts of any length are hashed
where they are read. In a table, columns named shard, size, text_crc32, law, slot or grown_shard are replaced; other columns
pass whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.numbering import numbered

from .common import table

SHARDS = 16
#: Hex digits of a draw: 52 bits, all of which a double holds.
_DIGITS = 13


def record_key(doc_id: Column, text: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.sha2(F.coalesce(text, F.lit("")), 256)))


def stretched_draw(key: Column, shard: Column, weight: Column) -> Column:
    """A shard's draw for a key, stretched by its weight."""
    u = F.conv(F.substring(F.md5(F.concat(key, F.lit("/"), shard.cast("string"))), 1, _DIGITS), 16, 10).cast("double")
    return weight / -F.ln((u + 0.5) / float(16**_DIGITS))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """(draw, -shard) of the shard that wins the key; of equal draws the lower shard's."""
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights are 0 or more, and one at least is above 0")
    of = F.array(*[F.lit(float(w)) for w in weights])
    draws = F.transform(of, lambda w, i: F.struct(stretched_draw(key, i, w).alias("draw"), (-i).alias("shard")))
    return F.array_max(draws)


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    return (-rendezvous(key, weights)["shard"]).cast("int")


def with_shards(docs: DataFrame, weights: Sequence[float], grown_weight: float = 1.0) -> DataFrame:
    """docs with `shard`, and `grown_shard`: where a row would be with one more shard, of this weight."""
    won, key = F.col("_won"), record_key(F.col("doc_id"), F.col("text"))
    more = stretched_draw(F.col("_key"), F.lit(len(weights)), F.lit(float(grown_weight)))
    placed = docs.withColumn("_key", key).withColumn("_won", rendezvous(F.col("_key"), weights)).withColumn("shard", (-won["shard"]).cast("int"))
    return placed.withColumn("grown_shard", F.when(more > won["draw"], len(weights)).otherwise(F.col("shard")).cast("int")).drop("_key", "_won")


def slotted(rows: DataFrame) -> DataFrame:
    """rows of doc_id, shard, text_crc32 and size with `slot`: gapless from 0 in each shard."""
    order = [*map(F.col, ("shard", "doc_id", "text_crc32", "size")), F.monotonically_increasing_id()]
    placed = numbered(rows, order, "slot")
    first = placed.groupBy("shard").agg(F.min("slot").alias("_first"))  # a row a shard
    return placed.join(F.broadcast(first), "shard").withColumn("slot", F.col("slot") - F.col("_first")).drop("_first")


def _measured(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("size", (F.octet_length(text) + 1).cast("long")).withColumn("text_crc32", F.crc32(text.cast("binary")))


def sharded(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row; texts are read once and never shuffled."""
    rows = _measured(with_shards(docs.select("doc_id", "text"), weights)).select("doc_id", "size", "text_crc32", "shard", "grown_shard")
    return slotted(rows).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, weights: Sequence[float] = (1.0,) * SHARDS, files: int = 1) -> DataFrame:
    """Whole rows in a folder a shard (`shard=3/`), each of about `files` files that share it by a salt; read back with `shard`."""
    spark = docs.sparkSession
    salt = F.pmod(F.xxhash64(record_key(F.col("doc_id"), F.col("text")), F.monotonically_increasing_id()), F.lit(files))
    placed = with_shards(docs, weights).drop("grown_shard").withColumn("_salt", salt)
    placed.repartition(len(weights) * files, "shard", "_salt").drop("_salt").write.partitionBy("shard").parquet(path)
    return spark.read.schema(placed.drop("_salt").schema).parquet(path)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"))


#: The checksum of a blob given as hex digits, byte by byte over the table of its polynomial (a fixed value), which is derived here.
CRC_SQL = """
crc_table AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc_of FROM range(256) t(i))"""


def crc_sql(text: str) -> str:
    """SQL for the unsigned CRC-32 of a text, where crc_of of crc_table is in scope."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, crc_of[1 + (xor(c, b) & 255)])), 4294967295)"


_DRAW = "({0} / -ln((CAST('0x' || substr(md5(key || '/' || {1}), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0))"

ORACLE_SQL = f"""
WITH {CRC_SQL.strip()},
d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(CAST(doc_id AS VARCHAR), 'text:' || sha256(coalesce(text, ''))) AS key FROM documents),
drawn AS (SELECT doc_id, t, list_transform(range({SHARDS + 1}), lambda i: {_DRAW.format('1.0', 'CAST(i AS VARCHAR)')}) AS draws FROM d),
won AS (SELECT doc_id, t, list_position(draws[1:{SHARDS}], list_max(draws[1:{SHARDS}])) - 1 AS shard, list_position(draws, list_max(draws)) - 1 AS grown_shard FROM drawn),
sized AS (SELECT doc_id, CAST(octet_length(encode(t)) + 1 AS BIGINT) AS size, CAST({crc_sql('t')} AS BIGINT) AS text_crc32, shard, grown_shard FROM won, crc_table)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard
FROM sized
"""
