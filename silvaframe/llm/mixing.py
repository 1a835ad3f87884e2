"""Mixing sources to target weights by temperature, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, md5_long, offsets_before

#: Documents of one block, and blocks of one run, on average.
BLOCK, RUN = 64, 4096
#: Halvings of the exponent's interval in one pass over the sources, and passes.
HALVINGS, PASSES = 5, 8


def _sums(sources: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """sum(p^e) and sum(p^e ln p) over all sources, for each exponent, in one aggregation."""
    p = F.col("share")
    row = sources.agg(*[F.sum(f).alias(f"{k}{i}") for i, e in enumerate(exponents) for k, f in (("z", F.pow(p, F.lit(e))), ("s", F.pow(p, F.lit(e)) * F.ln(p)))]).first()
    return [(row[f"z{i}"], row[f"s{i}"]) for i in range(len(exponents))]


def _bisect(sources: DataFrame, holds) -> float:
    """The largest exponent in [0, 1] at which `holds` (true at 0, monotone) is true, to 2^-40.

    Every pass evaluates the 31 midpoints that five halvings can meet, so forty halvings take eight
    small jobs, and the table of sources never leaves the cluster.
    """
    low, high = 0.0, 1.0
    (z, s), = _sums(sources, [1.0])
    if holds(1.0, z, s):
        return 1.0
    for _ in range(PASSES):
        n = 2**HALVINGS
        points = [low + (high - low) * i / n for i in range(1, n)]
        sums = _sums(sources, points)
        at, step = 0, n // 2
        while step:
            if holds(points[at + step - 1], *sums[at + step - 1]):
                at += step
            step //= 2
        low, high = low + (high - low) * at / n, low + (high - low) * (at + 1) / n
    return low


def temperature(sources: DataFrame, entropy_share: float, max_epochs: float, budget_share: float) -> float:
    """The exponent for source shares.

    The largest exponent whose weights reach the target entropy, which lies `entropy_share` of the way
    from the entropy of the shares to that of equal weights; raised, if some source would then be
    repeated more than `max_epochs` times, to the least exponent that keeps within the limit. Rounded to
    nine places so that the last bits of a power function do not matter.
    """
    n, low = sources.agg(F.count(F.lit(1)), F.min("share")).first()
    if n < 2:
        return 1.0
    (z, s), = _sums(sources, [1.0])
    natural = math.log(z) - s / z
    target = natural + entropy_share * (math.log(n) - natural)
    reach = _bisect(sources, lambda e, z, s: math.log(z) - e * s / z >= target)
    over = lambda e, z, s: budget_share * low ** (e - 1) / z > max_epochs
    return round(max(reach, _bisect(sources, over) if over(0.0, n, 0.0) else 0.0), 9)


def mix_sources(
    documents: DataFrame,
    entropy_share: float = 0.5,
    max_epochs: float = 4.0,
    budget_share: float = 1.0,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    row_col: str | None = None,
) -> DataFrame:
    """(doc_id, source, n_tokens, weight, copies), a row per document; first the column row_col where it is given.

    A source's share of all tokens (words) is raised to the exponent of `temperature` and normalised to
    its weight; weight x budget is its quota of tokens. Whole epochs of the source are taken while they
    fit. The last epoch is a permutation of the source's blocks of documents: blocks are taken whole up
    to the quota, and the block that crosses it up to the last document that fits. copies says how often
    a document is taken, 0 for none.

    Null sources are a source of their own. Null, empty and blank texts have no tokens and are not
    taken; a source without tokens has weight 0. Ids may be null or repeat: rows equal in id and tokens count as a range
    within their block, and only where the quota cuts the range itself are they numbered, over runs of bounded length, in
    an order that does not change their number of copies in total, by row_col where it is given. An empty table gives an empty result. Other columns are not read, so their names cannot clash.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "mix")
    docs = scratch.save(
        documents.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"),
            (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("_row"),
            F.concat_ws(":", F.when(F.col(id_col).isNull(), "0").otherwise("1"), F.col(id_col).cast("string")).alias("_id"),
        ).withColumn("_key", F.concat_ws(":", F.when(F.col("source").isNull(), "0").otherwise("1"), F.col("source").cast("string")))
    )
    per = scratch.save(docs.groupBy("_key").agg(F.sum("n_tokens").alias("_tokens"), F.sum(F.when(F.col("n_tokens") > 0, 1).otherwise(0)).alias("_docs")).where("_tokens > 0"))
    total = per.agg(F.sum("_tokens")).first()[0] or 0
    per = per.withColumn("share", F.col("_tokens") / F.lit(float(max(total, 1))))
    if total:
        e = temperature(per, entropy_share, max_epochs, budget_share)
        (z, _), = _sums(per, [e])
    else:
        e, z = 1.0, 1.0
    per = (
        per.withColumn("weight", F.pow("share", F.lit(e)) / F.lit(z))
        .withColumn("_quota", F.floor(F.col("weight") * F.lit(float(total) * budget_share)))
        .withColumn("_epochs", F.expr("_quota div _tokens"))
        .withColumn("_rest", F.expr("_quota % _tokens"))
        .withColumn("_blocks", F.expr(f"(_docs + {BLOCK - 1}) div {BLOCK}"))
        .drop("share", "_docs", "_quota")
    )
    rows = docs.join(per, "_key", "left").withColumn("_block", F.when(F.col("n_tokens") > 0, F.pmod(md5_long("doc_id", "n_tokens", F.lit(seed)), "_blocks")))

    blocks = rows.where("n_tokens > 0").groupBy("_key", "_block").agg(F.sum("n_tokens").alias("_size"), F.first("_epochs").alias("_e"), F.first("_blocks").alias("_b"))
    blocks = blocks.withColumn("_order", md5_long("_key", "_block", "_e", F.lit(seed))).withColumn("_runs", F.pmod("_order", F.expr(f"(_b + {RUN - 1}) div {RUN}")))
    blocks = offsets_before(blocks, ["_key"], "_runs", ["_order", "_block"], "_size", "_before").select("_key", "_block", "_before", "_size")

    rows = rows.join(blocks, ["_key", "_block"], "left")
    # only blocks that the quota cuts need their documents in order
    cut = (F.col("_before") < F.col("_rest")) & (F.col("_before") + F.col("_size") > F.col("_rest"))
    whole = rows.where(~F.coalesce(cut, F.lit(False))).withColumn("_in", F.when(F.col("_before") + F.col("_size") <= F.col("_rest"), 1).otherwise(0))
    same = ["_key", "_block", "_id", "n_tokens"]
    part = scratch.save(rows.where(cut))
    ranges = part.groupBy(*same).agg(F.count(F.lit(1)).alias("_n"), F.first("doc_id").alias("doc_id"), F.first(F.col("_rest") - F.col("_before")).alias("_left"))
    inner = Window.partitionBy("_key", "_block").orderBy(md5_long("doc_id", "n_tokens", F.lit(seed + 1)), "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("_left") - F.coalesce(F.sum(F.col("_n") * F.col("n_tokens")).over(inner), F.lit(0))
    ranges = scratch.save(ranges.withColumn("_fit", F.greatest(F.least(F.expr("_n * n_tokens"), left), F.lit(0))).select(*same, "_n", F.expr("_fit div n_tokens").alias("_fit")))
    part = part.join(ranges, same)
    clear = part.where("_fit = 0 or _fit = _n").withColumn("_in", F.when(F.col("_fit") > 0, 1).otherwise(0))
    # rows of a range that the quota cuts
    split = part.where("_fit > 0 and _fit < _n").withColumn("_span", F.pmod(F.xxhash64("_row"), F.expr(f"(_n + {RUN - 1}) div {RUN}"))).withColumn("_one", F.lit(1))
    split = offsets_before(split, same, "_span", ["_row"], "_one", "_at").withColumn("_in", F.when(F.col("_at") < F.col("_fit"), 1).otherwise(0))
    part = clear.unionByName(split.select(*clear.columns))
    return whole.unionByName(part.select(*whole.columns)).select(
        *([F.col("_row").alias(row_col)] if row_col else []),
        "doc_id",
        "source",
        "n_tokens",
        F.round(F.coalesce("weight", F.lit(0.0)), 9).alias("weight"),
        F.when(F.col("n_tokens") > 0, F.col("_epochs") + F.col("_in")).otherwise(0).cast("long").alias("copies"),
    )


def mix_oracle(entropy_share: float = 0.5, max_epochs: float = 4.0, budget_share: float = 1.0, seed: int = 7) -> str:
    """The same in DuckDB's SQL: forty halvings as a recursive table, running sums as plain windows."""
    h = lambda *c: "('0x' || substr(md5(concat_ws('|', " + ", ".join(f"coalesce(({x})::VARCHAR, '')" for x in c) + ")), 1, 15))::BIGINT"
    ent = "ln(list_sum(list_transform(ps, lambda p: pow(p, {e})))) - {e} * list_sum(list_transform(ps, lambda p: pow(p, {e}) * ln(p))) / list_sum(list_transform(ps, lambda p: pow(p, {e})))"
    rep = f"{budget_share}::DOUBLE * pow(list_min(ps), {{e}} - 1) / list_sum(list_transform(ps, lambda p: pow(p, {{e}}))) > {max_epochs}::DOUBLE"
    mid = "((lo + hi) / 2)"
    return f"""
    WITH RECURSIVE d AS (
      SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens,
             concat_ws(':', CASE WHEN source IS NULL THEN '0' ELSE '1' END, source) AS k FROM documents),
    s0 AS (SELECT k, sum(n_tokens)::BIGINT AS tokens, count(*) FILTER (n_tokens > 0) AS docs FROM d GROUP BY k HAVING sum(n_tokens) > 0),
    tot AS (SELECT sum(tokens)::BIGINT AS total FROM s0),
    s1 AS (SELECT s0.*, tokens / total::DOUBLE AS share, total FROM s0, tot),
    a AS (SELECT list(share) AS ps, count(*) AS n FROM s1),
    goal AS (SELECT ps, n, nat + {entropy_share}::DOUBLE * (ln(n) - nat) AS goal FROM (SELECT ps, n, {ent.format(e='1.0::DOUBLE')} AS nat FROM a)),
    b1 AS (SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi UNION ALL
      SELECT i + 1, CASE WHEN ({ent.format(e=mid)}) >= goal THEN {mid} ELSE lo END, CASE WHEN ({ent.format(e=mid)}) >= goal THEN hi ELSE {mid} END FROM b1, goal WHERE i < 40),
    b2 AS (SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi UNION ALL
      SELECT i + 1, CASE WHEN {rep.format(e=mid)} THEN {mid} ELSE lo END, CASE WHEN {rep.format(e=mid)} THEN hi ELSE {mid} END FROM b2, goal WHERE i < 40),
    ex AS (SELECT round(CASE WHEN n < 2 THEN 1.0::DOUBLE ELSE greatest(
        CASE WHEN ({ent.format(e='1.0::DOUBLE')}) >= goal THEN 1.0::DOUBLE ELSE (SELECT lo FROM b1 WHERE i = 40) END,
        CASE WHEN NOT ({rep.format(e='0.0::DOUBLE')}) THEN 0.0::DOUBLE WHEN {rep.format(e='1.0::DOUBLE')} THEN 1.0::DOUBLE ELSE (SELECT lo FROM b2 WHERE i = 40) END) END, 9) AS e FROM goal),
    w AS (SELECT k, tokens, docs, total, pow(share, e) / sum(pow(share, e)) OVER () AS weight FROM s1, ex),
    q AS (SELECT *, (docs + {BLOCK - 1}) // {BLOCK} AS nb, floor(weight * (total::DOUBLE * {budget_share}::DOUBLE))::BIGINT AS quota FROM w),
    r AS (SELECT d.*, weight, quota // tokens AS epochs, quota % tokens AS rest, nb,
      CASE WHEN n_tokens > 0 THEN {h('doc_id', 'n_tokens', str(seed))} % nb END AS block FROM d LEFT JOIN q USING (k)),
    bl AS (SELECT k, block, sum(n_tokens)::BIGINT AS size, {h('k', 'block', 'any_value(epochs)', str(seed))} AS o, any_value(nb) AS nb FROM r WHERE n_tokens > 0 GROUP BY k, block),
    bo AS (SELECT k, block, coalesce(sum(size) OVER (PARTITION BY k ORDER BY o % ((nb + {RUN - 1}) // {RUN}), o, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM bl),
    f AS (SELECT r.*, before + sum(n_tokens) OVER (PARTITION BY k, block ORDER BY {h('doc_id', 'n_tokens', str(seed + 1))}, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS upto
      FROM r LEFT JOIN bo USING (k, block))
    SELECT doc_id, source, n_tokens, round(coalesce(weight, 0.0::DOUBLE), 9) AS weight,
      CASE WHEN n_tokens > 0 THEN epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END ELSE 0 END::BIGINT AS copies FROM f"""
