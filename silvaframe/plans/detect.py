"""Queries over detections: scores, pairs, suppression, numbering, candidate pools."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silvaframe.functions import conflicts, rules
from silvaframe.functions.geometry import DIST_SQL, LENS_SQL, distance, lens_area
from silvaframe.operators import candidates
from silvaframe.operators.spatial import box_reach, grid_pairs, widest
from silvaframe.operators.suppress import first_suppressor, renumber, suppress
from silvaframe.plans.registry import query
from silvaframe.sources.fixtures import view, with_views


def crowns(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "crowns")


def boxed(df: DataFrame) -> DataFrame:
    """Boxes around circles, as a tiled detector reports them."""
    return df.withColumns({"x1": F.col("x") - F.col("radius"), "y1": F.col("y") - F.col("radius"), "x2": F.col("x") + F.col("radius"), "y2": F.col("y") + F.col("radius")})


def scored(df: DataFrame) -> DataFrame:
    return df.withColumn("quality", rules.quality(F.col("source"), F.col("circularity"), F.col("fill_ratio"), F.lit(None).cast("double"), F.col("radius"), F.col("area_px")))


_D = DIST_SQL.format(a="r", b="e")
_LENS = LENS_SQL.format(r1="r.radius", r2="e.radius", d=f"({_D})")
_SMALL, _LARGE = "least(r.radius, e.radius)::DOUBLE", "greatest(r.radius, e.radius)::DOUBLE"


def greedy_sql(order: str, conflict: str, rows: str = "SELECT * FROM crowns", then: str = "SELECT image_id, idx FROM kept") -> str:
    """Greedy suppression as a recursive table: one row of each image a step, with the list of kept rows."""
    return with_views(
        f"""WITH RECURSIVE base AS ({rows}), r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY {order}) AS rn FROM base),
    g AS (SELECT image_id, 0::BIGINT AS rn, []::STRUCT(x INT, y INT, radius INT, idx BIGINT)[] AS kept FROM r GROUP BY image_id
      UNION ALL SELECT g.image_id, r.rn, CASE WHEN len(list_filter(g.kept, lambda e: {conflict})) > 0 THEN g.kept
        ELSE list_append(g.kept, {{'x': r.x, 'y': r.y, 'radius': r.radius, 'idx': r.idx}}) END FROM g JOIN r ON r.image_id = g.image_id AND r.rn = g.rn + 1),
    kept AS (SELECT g.image_id, unnest(g.kept).idx AS idx FROM g JOIN (SELECT image_id, max(rn) AS m FROM r GROUP BY image_id) l ON l.image_id = g.image_id AND l.m = g.rn)
    {then}""",
        "crowns",
    )




def by_area():
    return [-F.col("area_px"), -F.col("radius"), F.col("idx")]


def by_quality():
    return [-F.col("quality"), F.col("idx")]


D1_SQL = f"{_LENS} >= {{t}}::DOUBLE * (pi() * {_SMALL} * {_SMALL})"


@query(greedy_sql("area_px DESC, radius DESC, idx", D1_SQL.format(t=0.78), then="SELECT source, count(*) AS crowns, sum(c.id)::BIGINT AS id_sum FROM (SELECT source, row_number() OVER (PARTITION BY k.image_id ORDER BY y, x, k.idx) AS id FROM kept k JOIN base b ON b.image_id = k.image_id AND b.idx = k.idx) c GROUP BY source"))
def crowns_by_source(spark, d):
    """Flagship: overlapping crowns removed, renumbered by position, counted by source."""
    c = crowns(spark, d)
    kept = renumber(suppress(c, by_area(), conflicts.overlap(0.78), widest(c, 2.0, 10)))
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("crowns"), F.sum("id").alias("id_sum"))


@query(greedy_sql("area_px DESC, radius DESC, idx", D1_SQL.format(t=0.62)))
def d1_overlap(spark, d):
    c = crowns(spark, d)
    return suppress(c, by_area(), conflicts.overlap(0.62), widest(c, 2.0, 10)).select("image_id", "idx")


_RS, _RL = f"({_LENS}) / (pi() * {_SMALL} * {_SMALL})", f"({_LENS}) / (pi() * {_LARGE} * {_LARGE})"
_QROWS = f"SELECT *, {rules.QUALITY_SQL} AS quality FROM crowns"
_POOL = f"""(({_D}) <= greatest(3.0::DOUBLE, {_SMALL} * 0.25::DOUBLE) OR (({_D}) <= greatest(5.0::DOUBLE, {_SMALL} * 0.5::DOUBLE) AND {_RS} >= 0.38::DOUBLE)
 OR (({_RS} >= {{t}} OR {_RL} >= {{t}} * 0.70::DOUBLE) AND ({_D}) <= greatest(10.0::DOUBLE, {_SMALL} * 0.85::DOUBLE))
 OR (({_RS} >= {{t}} * 0.65::DOUBLE OR {_RL} >= {{t}} * 0.50::DOUBLE) AND ({_D}) <= greatest(6.0::DOUBLE, {_SMALL} * 0.55::DOUBLE)))"""


@query(greedy_sql("quality DESC, idx", _POOL.format(t="0.74::DOUBLE"), _QROWS))
def d2_candidate_pool(spark, d):
    c = scored(crowns(spark, d))
    return suppress(c, by_quality(), conflicts.pool(0.74), widest(c, 2.0, 10)).select("image_id", "idx")


_DENSE = f"""({_SMALL} >= 0.35::DOUBLE * {_LARGE} AND (({_D}) <= greatest(7.0::DOUBLE, {_SMALL} * 0.82::DOUBLE)
 OR (({_D}) + {_SMALL} <= {_LARGE} * 1.08::DOUBLE AND {_RS} >= 0.35::DOUBLE) OR (({_D}) <= greatest(10.0::DOUBLE, {_SMALL} * 1.8::DOUBLE) AND {_RS} >= 0.10::DOUBLE)))"""


@query(
    greedy_sql(
        "quality DESC, idx",
        _DENSE,
        _QROWS,
        f"""SELECT image_id, idx, NULL::INT AS duplicate_of_x, NULL::INT AS duplicate_of_y, NULL::INT AS duplicate_of_radius, 'kept_refined' AS local_refine_decision FROM kept UNION ALL
        SELECT image_id, idx, f.x, f.y, f.radius, 'rejected_dense_duplicate' FROM (SELECT r.image_id, r.idx, min_by({{'x': e.x, 'y': e.y, 'radius': e.radius}}, e.rn) AS f
          FROM r JOIN r e ON e.image_id = r.image_id AND e.rn < r.rn JOIN kept k ON k.image_id = e.image_id AND k.idx = e.idx
          WHERE NOT EXISTS (SELECT 1 FROM kept z WHERE z.image_id = r.image_id AND z.idx = r.idx) AND {_DENSE} GROUP BY r.image_id, r.idx)""",
    )
)
def d3_dense(spark, d):
    """Kept rows, and removed ones with the best kept row that removed them."""
    c = scored(crowns(spark, d))
    rule, cell = conflicts.dense(), widest(c, 2.0, 10)
    kept = suppress(c, by_quality(), rule, cell)
    gone = first_suppressor(c, kept, by_quality(), rule, cell)
    none = F.lit(None).cast("int")
    kept = kept.select("image_id", "idx", none.alias("duplicate_of_x"), none.alias("duplicate_of_y"), none.alias("duplicate_of_radius"), F.lit("kept_refined").alias("local_refine_decision"))
    return kept.unionByName(gone.select("image_id", "idx", "duplicate_of_x", "duplicate_of_y", "duplicate_of_radius", F.lit("rejected_dense_duplicate").alias("local_refine_decision")))


_W = "greatest(0, least(r.x + r.radius, e.x + e.radius) - greatest(r.x - r.radius, e.x - e.radius))"
_H = _W.replace(".x", ".y")
_AREA = "greatest(1.0::DOUBLE, 4.0::DOUBLE * {0}.radius * {0}.radius)"
_NMS = f"""(({_W} * {_H}) / ({_AREA.format('r')} + {_AREA.format('e')} - {_W} * {_H}) >= 0.45::DOUBLE
 OR ({_SMALL} >= 0.40::DOUBLE * {_LARGE} AND ({_D}) <= greatest(8.0::DOUBLE, {_SMALL} * 1.25::DOUBLE)))"""


@query(greedy_sql("conf DESC, idx", _NMS))
def d4_box_nms(spark, d):
    c = boxed(crowns(spark, d))
    return suppress(c, [-F.col("conf"), F.col("idx")], conflicts.boxes(), widest(c, 2.0, 10), reach=box_reach).select("image_id", "idx")


_SAME = f"(({_D}) <= greatest({{least}}::DOUBLE, greatest(1.0::DOUBLE, {_SMALL}) * {{share}}::DOUBLE) OR {_LENS} >= {{t}}::DOUBLE * (pi() * {_SMALL} * {_SMALL}))"


@query(greedy_sql("conf DESC, radius DESC, idx", _SAME.format(least=4.0, share=0.38, t=0.62)))
def d5_red_circles(spark, d):
    c = crowns(spark, d)
    return suppress(c, [-F.col("conf"), -F.col("radius"), F.col("idx")], conflicts.same_circle(4.0, 0.38, 0.62), widest(c, 2.0, 10)).select("image_id", "idx")


@query(
    greedy_sql(
        "source_rank DESC, llm_confidence DESC, radius DESC, idx",
        _SAME.format(least=5.0, share=0.45, t=0.58),
        "SELECT *, CASE idx % 5 WHEN 0 THEN 5 WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE 0 END AS source_rank, idx % 101 AS llm_confidence FROM crowns",
    )
)
def d6_repaired(spark, d):
    c = crowns(spark, d)
    kind = F.element_at(F.array(*[F.lit(s) for s in ("llm_adjust", "llm_add", "llm_keep", "opencv", "recall")]), (F.col("idx") % 5 + 1).cast("int"))
    c = c.withColumn("source_rank", rules.case_of(kind, rules.REPAIR_RANK, 0)).withColumn("llm_confidence", F.col("idx") % 101)
    rank = [-F.col("source_rank"), -F.col("llm_confidence"), -F.col("radius"), F.col("idx")]
    return suppress(c, rank, conflicts.same_circle(5.0, 0.45, 0.58), widest(c, 2.0, 10)).select("image_id", "idx")


_NEAR = f"({_D}) <= greatest(6.0::DOUBLE, {_SMALL} * 0.90::DOUBLE)"


@query(
    greedy_sql(
        "idx",
        _NEAR,
        f"SELECT * FROM crowns r WHERE source = 'peak' AND NOT EXISTS (SELECT 1 FROM crowns e WHERE e.image_id = r.image_id AND e.source <> 'peak' AND {_NEAR})",
    )
)
def d7_peak_supplement(spark, d):
    """Peaks near no other detection, taken in order unless near a peak already taken."""
    c = crowns(spark, d)
    cell, rule = widest(c, 1.0, 10), conflicts.proximity(0.90)
    peaks = grid_pairs(c.where("source = 'peak'"), c.where("source <> 'peak'"), ["image_id"], cell, rule, "left_anti").select("p.*")
    return suppress(peaks, [F.col("idx")], rule, cell).select("image_id", "idx")


@query(with_views(f"SELECT image_id, idx, round({rules.QUALITY_SQL}, 6) AS quality FROM crowns", "crowns"))
def candidate_quality(spark, d):
    return scored(crowns(spark, d)).select("image_id", "idx", F.round("quality", 6).alias("quality"))


@query(
    with_views(
        f"SELECT image_id, count(*) AS pairs, round(sum(area), 3) AS area FROM (SELECT r.image_id, {_LENS} AS area FROM crowns r JOIN crowns e ON e.image_id = r.image_id AND r.idx < e.idx WHERE ({_D}) < r.radius + e.radius) p GROUP BY image_id",
        "crowns",
    )
)
def j1_overlaps(spark, d):
    """Pairs of discs with some area in common, by image."""
    c = crowns(spark, d)
    dist = lambda p, q: distance(p("x"), p("y"), q("x"), q("y"))
    pairs = grid_pairs(c, c, ["image_id"], widest(c, 2.0, 10), lambda p, q: (p("idx") < q("idx")) & (dist(p, q) < p("radius") + q("radius")))
    p, q = (lambda c: F.col(f"p.{c}")), (lambda c: F.col(f"q.{c}"))
    return pairs.select(F.col("p.image_id").alias("image_id"), lens_area(p("radius"), q("radius"), dist(p, q)).alias("area")).groupBy("image_id").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.sum("area"), 3).alias("area"))


@query(with_views(f"SELECT image_id, idx FROM crowns r WHERE source = 'residual' AND NOT EXISTS (SELECT 1 FROM crowns e WHERE e.image_id = r.image_id AND e.source = 'reference' AND ({_D}) <= greatest(6.0::DOUBLE, {_SMALL} * 0.72::DOUBLE))", "crowns"))
def j2_not_near(spark, d):
    """Residual detections that are near no reference one."""
    c = crowns(spark, d)
    return grid_pairs(c.where("source = 'residual'"), c.where("source = 'reference'"), ["image_id"], widest(c, 1.0, 10), conflicts.proximity(0.72), "left_anti").select("p.image_id", "p.idx")


@query(with_views("SELECT image_id, idx, row_number() OVER (PARTITION BY image_id ORDER BY y, x, idx)::INT AS id, (row_number() OVER (PARTITION BY image_id ORDER BY idx))::INT AS position, ((row_number() OVER (PARTITION BY image_id ORDER BY idx) - 1) // 9)::INT AS batch FROM crowns", "crowns"))
def w_numbering(spark, d):
    """Numbers by place, by position, and batches of nine."""
    return candidates.batches(renumber(crowns(spark, d)), 9).select("image_id", "idx", "id", "position", "batch")


@query(
    with_views(
        """SELECT preset, source, count(*) AS candidates FROM (SELECT * FROM crowns) c JOIN (VALUES ('precision', 0.60::DOUBLE, 0.45::DOUBLE, 120.0::DOUBLE, 3000.0::DOUBLE, 10, 50), ('balanced', 0.45::DOUBLE, 0.35::DOUBLE, 90.0::DOUBLE, 3500.0::DOUBLE, 8, 55), ('recall', 0.25::DOUBLE, 0.22::DOUBLE, 60.0::DOUBLE, 4100.0::DOUBLE, 6, 60))
    p(preset, circ, fill, low, high, r_low, r_high) ON circularity >= circ AND fill_ratio >= fill AND area_px BETWEEN low AND high AND radius BETWEEN r_low AND r_high GROUP BY preset, source""",
        "crowns",
    )
)
def gen8_presets(spark, d):
    """Candidates that pass each preset's shape limits."""
    return candidates.by_preset(crowns(spark, d), candidates.preset_table(spark)).groupBy("preset", "source").agg(F.count(F.lit(1)).alias("candidates"))


_COMP = "SELECT *, (radius * 1.0::DOUBLE + idx % 7) AS enclosing, (6.0::DOUBLE * radius) AS perimeter, (radius + idx % 11) AS bw, (radius + idx % 17) AS bh, (2 + idx % 12)::DOUBLE AS peak FROM crowns"


def components(c: DataFrame) -> DataFrame:
    """Component statistics that the candidate rules read."""
    i = F.col("idx")
    return c.withColumns({"enclosing": F.col("radius") * 1.0 + i % 7, "perimeter": F.col("radius") * 6.0, "bw": F.col("radius") + i % 11, "bh": F.col("radius") + i % 17, "peak": (2 + i % 12).cast("double")})


@query(
    with_views(
        f"""SELECT image_id, idx, r AS radius_out, round(circ, 3) AS circ, round(fill, 3) AS fill FROM (SELECT *, round_even(1.1::DOUBLE * enclosing, 0)::INT AS r, 4 * pi() * area_px / (perimeter * perimeter) AS circ, area_px / (pi() * enclosing * enclosing) AS fill FROM ({_COMP}))
    WHERE area_px BETWEEN 60 AND 3500 AND circ >= 0.20::DOUBLE AND fill >= 0.18::DOUBLE AND greatest(bw, bh) / greatest(1, least(bw, bh))::DOUBLE <= 2.8::DOUBLE AND r BETWEEN 6 AND 60""",
        "crowns",
    )
)
def gen1_labels(spark, d):
    out = candidates.from_components(components(crowns(spark, d)), area=(60, 3500), circ=0.20, fill=0.18, ratio=2.8, scale=1.1, radius=(6, 60))
    return out.select("image_id", "idx", "radius_out", F.round("circ", 3).alias("circ"), F.round("fill", 3).alias("fill"))


@query(
    with_views(
        f"""SELECT image_id, idx, r AS radius_out FROM (SELECT *, round_even(least(0.95::DOUBLE * enclosing, greatest(1.70::DOUBLE * peak + 3, 0.95::DOUBLE * sqrt(area_px / pi()), 6)), 0)::INT AS r FROM ({_COMP}))
    WHERE area_px BETWEEN 60 AND 3500 AND 4 * pi() * area_px / (perimeter * perimeter) >= 0.20::DOUBLE AND area_px / (pi() * enclosing * enclosing) >= 0.18::DOUBLE AND greatest(bw, bh) / greatest(1, least(bw, bh))::DOUBLE <= 2.7::DOUBLE AND r BETWEEN 6 AND 60""",
        "crowns",
    )
)
def gen2_peak_radius(spark, d):
    out = candidates.from_components(components(crowns(spark, d)), area=(60, 3500), circ=0.20, fill=0.18, ratio=2.7, scale=None, radius=(6, 60))
    return out.select("image_id", "idx", "radius_out")


@query(with_views(f"SELECT image_id, idx, trunc(enclosing)::INT AS radius_out FROM ({_COMP}) WHERE area_px >= 80 AND area_px <= 0.02::DOUBLE * 640 * 480 AND 4 * pi() * area_px / (perimeter * perimeter) >= 0.30::DOUBLE AND trunc(enclosing)::INT >= 4 AND enclosing <= 0.08::DOUBLE * 480", "crowns"))
def gen3_original(spark, d):
    return candidates.original(components(crowns(spark, d)), 640, 480, least_area=80, circ=0.30).select("image_id", "idx", "radius_out")


@query(
    greedy_sql(
        "quality DESC, idx",
        _POOL.format(t="0.74::DOUBLE"),
        f"SELECT * EXCLUDE (source), source, {rules.QUALITY_SQL} AS quality FROM (SELECT * FROM crowns WHERE source = 'reference' UNION ALL SELECT * FROM crowns WHERE source = 'recall' UNION ALL SELECT * FROM crowns WHERE source = 'residual')",
        "SELECT k.image_id, k.idx, row_number() OVER (PARTITION BY k.image_id ORDER BY b.y, b.x, k.idx)::INT AS id, b.source FROM kept k JOIN base b ON b.image_id = k.image_id AND b.idx = k.idx",
    )
)
def gen11_ensemble(spark, d):
    """Candidate lists put together, deduplicated by quality, and numbered by place."""
    c = crowns(spark, d)
    return candidates.ensemble([c.where(F.col("source") == s) for s in ("reference", "recall", "residual")], 0.74).select("image_id", "idx", "id", "source")


@query(with_views("SELECT image_id, idx, round_even(x * 1.75::DOUBLE, 0)::INT AS x, round_even(y * 2.25::DOUBLE, 0)::INT AS y, round_even(radius * 2.0::DOUBLE, 0)::INT AS radius, round_even(area_px * (1.75::DOUBLE * 2.25::DOUBLE), 2) AS area_px FROM crowns", "crowns"))
def e6_rescale(spark, d):
    return candidates.rescale(crowns(spark, d), 1.75, 2.25).select("image_id", "idx", "x", "y", "radius", "area_px")


