"""Sharding by extendible hashing, with DataFrame operations only.

A row's hash has 60 bits, of its id and its text, so that rows of one crowded id are spread. A shard is a prefix of
bits. One shard of no bits holds everything; a shard over the byte limit is split on one more bit, and only such a one, until all fit. The
directory is computed without splitting step by step: bytes are summed once for cells of so many bits as the
total calls for, the cells' sums are added up for all shorter prefixes, and each cell goes to its shortest prefix that fits.
Cells that are too large themselves go through more bits, with their rows alone.

A row over the limit is a shard of its own, named by its hash and a `!`. Rows that are equal in id and text have equal
hashes; should they not fit together, they are dealt in order to overflow shards, named by the hash and a number. Null texts have 0 bytes, null ids are
hashed as empty. An empty table gives an empty one. Only the two named columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written

BITS = 60
#: Bytes of a shard in the query.
LIMIT = 4 << 20
#: Bits beyond those that a perfectly even table would need, and bits more in each further round.
SPARE, MORE = 4, 8


def row_hash(id_col: str, text_col: str) -> Column:
    """The first 60 bits of an MD5 hash."""
    text = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text_col), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def prefix(h: Column, depth: Column) -> Column:
    return F.when(depth == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftright", h, (F.lit(BITS) - depth).cast("int")))


def _sums(cells: DataFrame, low: int, high: int, bits: int) -> DataFrame:
    """cell, d, bytes, n of all prefixes of each cell from low to high bits."""
    each = cells.select("cell", "bytes", "n", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("d")).withColumn("p", F.call_function("shiftright", F.col("cell"), (F.lit(bits) - F.col("d")).cast("int")))
    total = each.groupBy("d", "p").agg(F.sum("bytes").alias("sb"), F.sum("n").alias("sn"))
    return each.select("cell", "d", "p").join(total, ["d", "p"])


def _shortest(sums: DataFrame, limit: int) -> DataFrame:
    return sums.where(F.col("sb") <= limit).groupBy("cell").agg(F.min(F.struct("d", "sb", "sn")).alias("leaf"))


def shards(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, shard_id (the prefix, in bits), depth, shard_bytes, shard_docs of each row."""
    rows = written(docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), row_hash(id_col, text_col).alias("h")), "hashed")
    bits_of = lambda h, depth: F.when(depth == 0, F.lit("")).otherwise(F.lpad(F.conv(prefix(h, depth).cast("string"), 10, 2), depth, F.lit("0")))
    large = rows.where(F.col("n_bytes") > limit).select("id", "n_bytes", F.concat(bits_of(F.col("h"), F.lit(BITS)), F.lit("!")).alias("shard_id"), F.lit(BITS).alias("depth"), F.col("n_bytes").alias("shard_bytes"), F.lit(1).cast("long").alias("shard_docs"))
    rest = rows.where(F.col("n_bytes") <= limit)
    total = rest.agg(F.sum("n_bytes")).first()[0] or 0
    even = max(0, math.ceil(math.log2(max(total, 1) / limit)))
    parts, low, bits = [large], 0, min(BITS, even + SPARE)
    while True:
        cells = written(rest.groupBy(prefix(F.col("h"), F.lit(bits)).alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n")), "cells")
        # prefixes far shorter than an even table's are summed from the sums of one in between, of which there are few
        middle = max(low, even - SPARE) if not low else low
        leaf = _shortest(_sums(cells, middle, bits, bits), limit)
        found = cells.join(leaf, "cell", "left").withColumn("up", F.call_function("shiftright", F.col("cell"), F.lit(bits - middle)))
        if middle > low:
            upper = cells.groupBy(F.call_function("shiftright", F.col("cell"), F.lit(bits - middle)).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
            above = _shortest(_sums(upper, low, middle, middle), limit).select(F.col("cell").alias("up"), F.col("leaf").alias("above"))
            found = found.join(above, "up", "left").withColumn("leaf", F.coalesce("above", "leaf"))
        found = written(found.select("cell", "leaf"), "directory")
        dealt = rest.withColumn("cell", prefix(F.col("h"), F.lit(bits))).join(found, "cell")
        fits = dealt.where("leaf IS NOT NULL")
        parts.append(fits.select("id", "n_bytes", bits_of(F.col("h"), F.col("leaf.d")).alias("shard_id"), F.col("leaf.d").alias("depth"), F.col("leaf.sb").alias("shard_bytes"), F.col("leaf.sn").alias("shard_docs")))
        if not found.where("leaf IS NULL").take(1):
            break
        rest = dealt.where("leaf IS NULL").select("id", "n_bytes", "h")
        if bits == BITS:
            # equal rows: as many together as fit
            order = F.row_number().over(W.partitionBy("h").orderBy("id")) - 1
            chunk = F.floor(order / F.floor(F.lit(limit) / F.greatest("n_bytes", F.lit(1)))).cast("string")
            named = rest.withColumn("shard_id", F.concat(bits_of(F.col("h"), F.lit(BITS)), F.lit("/"), chunk))
            of_shard = W.partitionBy("shard_id")
            parts.append(named.select("id", "n_bytes", "shard_id", F.lit(BITS).alias("depth"), F.sum("n_bytes").over(of_shard).alias("shard_bytes"), F.count("*").over(of_shard).alias("shard_docs")))
            break
        rest = written(rest, "oversized")
        low, bits = bits + 1, min(BITS, bits + MORE)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH r AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents
), e AS (
  SELECT d, CASE WHEN d = 0 THEN 0 ELSE h >> ({BITS} - d) END AS p, sum(n_bytes) AS sb, count(*) AS sn
  FROM r, range(0, 41) AS t(d) WHERE n_bytes <= {LIMIT} GROUP BY ALL
), m AS (
  SELECT r.doc_id, r.n_bytes, r.h, min(e.d) AS depth
  FROM r JOIN e ON e.p = CASE WHEN e.d = 0 THEN 0 ELSE r.h >> ({BITS} - e.d) END
  WHERE r.n_bytes <= {LIMIT} AND e.sb <= {LIMIT} GROUP BY ALL
)
SELECT m.doc_id, m.n_bytes, CASE WHEN depth = 0 THEN '' ELSE right(bin(m.h + (1::BIGINT << {BITS})), {BITS})[1:depth] END AS shard_id,
  depth::INTEGER AS depth, e.sb::BIGINT AS shard_bytes, e.sn::BIGINT AS shard_docs
FROM m JOIN e ON e.d = m.depth AND e.p = CASE WHEN m.depth = 0 THEN 0 ELSE m.h >> ({BITS} - m.depth) END
UNION ALL
SELECT doc_id, n_bytes, right(bin(h + (1::BIGINT << {BITS})), {BITS}) || '!', {BITS}, n_bytes, 1 FROM r WHERE n_bytes > {LIMIT}
"""
