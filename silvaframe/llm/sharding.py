"""Sharding: a Feistel permutation with cycle walking over global row numbers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, md5_long, mix, offsets_before

#: Rows of one numbering bucket, and buckets of one run, on average; copies of a row that are numbered in one stretch.
BUCKET, RUN, RANGE = 64, 4096, 1 << 16


def sides(n: int) -> tuple[int, int]:
    """The grid that n numbers are laid out on."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def keys(seed: int, rounds: int) -> list[tuple[int, int]]:
    """The keys of each pair of rounds."""
    first = [(seed * 1_000_003 + r + 1) * 0x9E3779B97F4A7C15 % 2**64 for r in range(0, rounds, 2)]
    return [(k, (k + 0x632BE59BD9B4E019) % 2**64) for k in first]


def feistel(x: np.ndarray, n: int, seed: int = 0, rounds: int = 6) -> np.ndarray:
    """A permutation of 0..n-1, applied to the numbers x.

    The cipher works on a grid of a x b >= n cells, a = ceil(sqrt(n)); each round adds a keyed hash of
    one half to the other, modulo its side. Numbers that land on n or above walk on along their cycle
    until they are inside again; at most a cells are outside, so walks are short.
    """
    a, b = sides(n)

    def once(v):
        left, right = v // np.uint64(b), v % np.uint64(b)
        for one, two in keys(seed, rounds):
            left = (left + mix(right ^ np.uint64(one)) % np.uint64(a)) % np.uint64(a)
            right = (right + mix(left ^ np.uint64(two)) % np.uint64(b)) % np.uint64(b)
        return left * np.uint64(b) + right

    with np.errstate(over="ignore"):
        out = once(np.asarray(x, np.uint64))
        while (outside := out >= n).any():
            out[outside] = once(out[outside])
    return out.astype(np.int64)


def number_rows(df: DataFrame, key: list[str], hashed: list[str]) -> tuple[DataFrame, int]:
    """Adds row_number_global, 0..n-1 without gaps, a function of the rows alone.

    Equal keys are counted before anything moves and numbered as one range, so copies of a key never
    meet in one window; a long range is dealt out in stretches of RANGE numbers. Rows fall into buckets by a hash of
    the columns `hashed`; a bucket's first number is the running sum of the buckets before it. Only the key columns are
    shuffled.
    """
    counted = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_copies"))
    total = df.count()
    buckets = max(1, math.ceil(total / BUCKET))
    counted = counted.withColumn("_bucket", F.pmod(md5_long(*hashed), F.lit(buckets)))
    sums = counted.groupBy("_bucket").agg(F.sum("_copies").alias("_n")).withColumn("_runs", F.expr(f"_bucket div {RUN}"))
    first = offsets_before(sums, [], "_runs", ["_bucket"], "_n", "_first").select("_bucket", "_first")
    inner = Window.partitionBy("_bucket").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("_before", F.coalesce(F.sum("_copies").over(inner), F.lit(0))).join(first, "_bucket")
    placed = placed.select(*key, (F.col("_first") + F.col("_before")).alias("_at"), "_copies")
    long = placed.where(F.col("_copies") > RANGE)
    long = long.select(*key, "_at", "_copies", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1, F.lit(RANGE).cast("long"))).alias("_skip"))
    long = long.repartition("_skip", *key).select(*key, (F.col("_at") + F.col("_skip")).alias("_at"), F.least(F.lit(RANGE), F.col("_copies") - F.col("_skip")).alias("_copies"))
    every = placed.where(F.col("_copies") <= RANGE).unionByName(long)
    return every.select(*key, F.explode(F.sequence("_at", F.col("_at") + F.col("_copies") - 1)).alias("row_number_global")), total


def shard(documents: DataFrame, shards: int = 16, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard), a row per document; law `rows`.

    Global row number r goes to place p = feistel(r); shard = p mod shards, slot = p div shards. Shard
    sizes differ by one row at most, slots have no gaps, and both follow from r, n and the seed alone.
    size: UTF-8 bytes of the text plus 1; a null text counts as empty. Null ids, repeated rows and empty
    tables are allowed; equal rows get neighbouring numbers. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = documents.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("_text"),
    )
    # texts are read once: everything after works on this narrow table
    rows = Scratch(documents.sparkSession, "shard").save(rows)
    numbered, total = number_rows(rows, ["doc_id", "size", "text_crc32", "_text"], ["doc_id", "size", "text_crc32"])

    @F.pandas_udf("long")
    def place(number: pd.Series) -> pd.Series:
        return pd.Series(feistel(number.to_numpy(), total, seed))

    return numbered.withColumn("_place", place("row_number_global")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod("_place", F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"_place div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def shard_oracle(shards: int = 16, seed: int = 1, rounds: int = 6) -> str:
    """The same in DuckDB's SQL: numbers by a plain window, the permutation by integer arithmetic, checksums byte by byte."""
    mul = lambda x, c: f"(({x})::UHUGEINT * {c}::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT"
    mixed = lambda x: (
        f"list_transform(list_transform(list_transform([{x}], lambda h: {mul('xor(h, h >> 30)', 0xBF58476D1CE4E5B9)}), lambda h: {mul('xor(h, h >> 27)', 0x94D049BB133111EB)}), lambda h: xor(h, h >> 31))[1]"
    )
    once = "[{{'l': ({v}) // b, 'r': ({v}) % b}}]"
    for one, two in keys(seed, rounds):
        once = f"list_transform({once}, lambda s: {{{{'l': (s.l + {mixed(f'xor(s.r, {one}::UBIGINT)')} % a) % a, 'r': s.r}}}})"
        once = f"list_transform({once}, lambda s: {{{{'l': s.l, 'r': (s.r + {mixed(f'xor(s.l, {two}::UBIGINT)')} % b) % b}}}})"
    walk = lambda v: f"list_transform({once.format(v=v)}, lambda s: s.l * b + s.r)[1]"
    return f"""
    WITH RECURSIVE bits AS (SELECT i, 0 AS k, i::UBIGINT AS c FROM range(0, 256) r(i)
      UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM bits WHERE k < 8),
    tab AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
    d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    raw AS (SELECT doc_id, octet_length(encode(t))::BIGINT + 1 AS size, list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: ('0x' || x)::UBIGINT)) AS bytes FROM d),
    s AS (SELECT doc_id, size, xor(list_reduce(bytes, lambda x, y: xor(x >> 8, tab[(xor(x, y) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT AS text_crc32 FROM raw, tab),
    g AS (SELECT n, a, greatest((n + a - 1) // a, 1)::UBIGINT AS b FROM (SELECT n, greatest(floor(sqrt(greatest(n - 1, 0)::DOUBLE))::BIGINT + 1, 1)::UBIGINT AS a FROM (SELECT count(*) AS n FROM s))),
    h AS (SELECT s.*, ('0x' || substr(md5(concat_ws('|', coalesce(doc_id::VARCHAR, ''), size::VARCHAR, text_crc32::VARCHAR)), 1, 15))::BIGINT % greatest((n + {BUCKET - 1}) // {BUCKET}, 1) AS bucket, n, a, b FROM s, g),
    o AS (SELECT doc_id, size, text_crc32, (row_number() OVER (ORDER BY bucket, doc_id NULLS FIRST, size, text_crc32) - 1)::UBIGINT AS r, n, a, b FROM h),
    f AS (SELECT r, {walk('r')} AS p, n, a, b FROM o UNION ALL SELECT r, {walk('p')} AS p, n, a, b FROM f WHERE p >= n)
    SELECT doc_id, size, text_crc32, 'rows' AS law, (p % {shards})::INT AS shard, (p // {shards})::BIGINT AS slot, NULL::INT AS grown_shard FROM o JOIN f USING (r) WHERE p < f.n"""
