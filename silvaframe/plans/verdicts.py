"""Queries over a model's verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from silvaframe.operators import tiles, verdicts
from silvaframe.plans.detect import _SAME
from silvaframe.plans.registry import query
from silvaframe.plans.tiling import TILES_SQL
from silvaframe.sources.fixtures import view, with_views

PARSED = r"""body AS (SELECT image_id, id AS answer, CASE WHEN regexp_extract(response_text, '(?s)```(?:json)?\s*(.*?)```', 1) <> '' THEN regexp_extract(response_text, '(?s)```(?:json)?\s*(.*?)```', 1) ELSE response_text END AS t FROM verdicts_raw),
arr AS (SELECT image_id, answer, regexp_extract(t, '(?s)\[.*\]', 0) AS j FROM body),
items AS (SELECT image_id, answer, unnest(range(0, json_array_length(j)::BIGINT)) AS pos, j FROM arr WHERE json_valid(j) AND j <> ''),
vs AS (SELECT image_id, answer, pos, try_cast(json_extract_string(j, '$[' || pos || '].id') AS BIGINT) AS id, json_extract_string(j, '$[' || pos || '].is_tree') AS b,
  json_extract_string(j, '$[' || pos || '].species') AS s, try_cast(trim(json_extract_string(j, '$[' || pos || '].confidence')) AS DOUBLE) AS c FROM items),
last AS (SELECT image_id, id, max_by({'b': b, 's': s, 'c': c}, {'a': answer, 'p': pos}) AS v FROM vs WHERE id IS NOT NULL GROUP BY image_id, id),
parsed AS (SELECT image_id, id, CASE WHEN lower(trim(v.b)) IN ('true', 'yes', 'y', '1') THEN true WHEN lower(trim(v.b)) IN ('false', 'no', 'n', '0') THEN false ELSE true END AS is_tree,
  coalesce(nullif(v.s, ''), '未知') AS species, coalesce(least(100, greatest(0, round_even(v.c, 0))), 0)::INT AS llm_confidence FROM last)"""
VERIFIED = PARSED + """, verified AS (SELECT c.*, coalesce(p.is_tree, true) AS is_tree, coalesce(p.species, '未知') AS species, coalesce(p.llm_confidence, 0) AS llm_confidence,
  CASE WHEN coalesce(p.is_tree, true) AND coalesce(p.llm_confidence, 0) < 50 THEN 'kept_low_confidence_tree' WHEN coalesce(p.is_tree, true) THEN 'verified_tree'
    WHEN coalesce(p.llm_confidence, 0) < 70 THEN 'kept_uncertain_non_tree' ELSE 'rejected_non_tree' END AS llm_decision FROM crowns c LEFT JOIN parsed p ON p.image_id = c.image_id AND p.id = c.idx)"""


@query(with_views(f"WITH {PARSED} SELECT * FROM parsed", "verdicts_raw"))
def l4_parse(spark, d):
    return verdicts.parse(view(spark, d, "verdicts_raw"))


@query(with_views(f"WITH {VERIFIED} SELECT image_id, idx, species, llm_confidence, llm_decision FROM verified", "verdicts_raw", "crowns"))
def l1_verify(spark, d):
    return verdicts.verify(view(spark, d, "crowns"), view(spark, d, "verdicts_raw")).select("image_id", "idx", "species", "llm_confidence", "llm_decision")


@query(with_views(f"WITH {VERIFIED} SELECT llm_decision, source, count(*) AS n, count(*) FILTER (species = 'oak') AS oaks, max(llm_confidence) AS top FROM verified GROUP BY llm_decision, source", "verdicts_raw", "crowns"))
def ag10_decisions(spark, d):
    v = verdicts.verify(view(spark, d, "crowns"), view(spark, d, "verdicts_raw"))
    return v.groupBy("llm_decision", "source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("species") == "oak").alias("oaks"), F.max("llm_confidence").alias("top"))


@query(with_views(f"WITH {VERIFIED} SELECT species, count(*) AS trees, row_number() OVER (ORDER BY count(*) DESC, min(idx))::INT AS place FROM verified WHERE NOT starts_with(llm_decision, 'rejected') GROUP BY species", "verdicts_raw", "crowns"))
def ag3_species(spark, d):
    return verdicts.species_counts(verdicts.verify(view(spark, d, "crowns"), view(spark, d, "verdicts_raw")))


@query(with_views("""SELECT image_id, '[' || string_agg('{"idx":' || idx || ',"x":' || x || ',"y":' || y || ',"radius":' || radius || '}', ',' ORDER BY idx) || ']' AS candidates FROM crowns GROUP BY image_id""", "crowns"))
def e23_prompt_table(spark, d):
    return verdicts.prompt_rows(view(spark, d, "crowns"))


#: Numbered detections of the images: the crowns within each; tiles of the images.
DETS = "SELECT c.image_id, row_number() OVER (PARTITION BY c.image_id ORDER BY idx) - 1 AS det_no, c.x, c.y, radius, source FROM crowns c JOIN images i ON i.image_id = c.image_id AND c.x < i.width AND c.y < i.height"


def repair_inputs(spark, d):
    images = view(spark, d, "images")
    text = DETS.replace("crowns c", "{crowns} c").replace("images i", "{images} i")
    dets = spark.sql(f"SELECT image_id, CAST(det_no AS BIGINT) AS det_no, x, y, radius, source FROM ({text})", crowns=view(spark, d, "crowns"), images=images)
    return dets, view(spark, d, "repair_actions"), tiles.generate_tiles(images)


def _repair_ctes(strict: bool) -> str:
    """Common table expressions up to `done`, the repaired rows; actions come from repair_actions."""
    missed = "shown AND NOT coalesce(reviewed, false)" if strict else "false"
    return f"""{TILES_SQL}, dets AS ({DETS}),
    scope AS (SELECT d.image_id, t.tile_idx, d.det_no FROM dets d JOIN tiles t ON t.image_id = d.image_id AND tx <= x AND x < tx + tw AND ty <= y AND y < ty + th),
    acts AS (SELECT a.*, least(100, greatest(0, confidence)) AS conf, CASE kind WHEN 'keep' THEN 0 WHEN 'reject' THEN 1 ELSE 2 END AS k,
      a.x < tw AND a.y < th AND a.radius BETWEEN 5 AND 80 AS ok, tx + a.x AS gx, ty + a.y AS gy FROM repair_actions a JOIN tiles t ON t.image_id = a.image_id AND t.tile_idx = a.tile_idx),
    inscope AS (SELECT a.* FROM acts a WHERE kind <> 'add' AND EXISTS (SELECT 1 FROM scope s WHERE s.image_id = a.image_id AND s.tile_idx = a.tile_idx AND s.det_no = a.det_no)),
    per AS (SELECT image_id, det_no, bool_or(kind = 'reject' AND conf >= 70) AS rejected, bool_or(kind <> 'adjust' OR conf >= 50) AS reviewed, bool_or(kind = 'reject' AND conf < 70) AS unsure,
      max_by({{'x': gx, 'y': gy, 'r': radius, 'c': conf}}, {{'t': tile_idx, 'k': k, 'p': pos}}) FILTER (kind = 'adjust' AND conf >= 50 AND ok) AS adj,
      list({{'s': k, 'c': conf}} ORDER BY tile_idx, k, pos) FILTER (k < 2) AS marks FROM inscope GROUP BY image_id, det_no),
    c2 AS (SELECT image_id, det_no, rejected, reviewed, unsure, adj, list_reduce(list_concat([{{'s': 0, 'c': 0}}], coalesce(marks, [])), lambda a, m: CASE WHEN m.s = 0 THEN {{'s': 0, 'c': greatest(a.c, m.c)}} ELSE {{'s': 0, 'c': m.c}} END).c AS conf FROM per),
    shown AS (SELECT DISTINCT s.image_id, s.det_no, true AS shown FROM scope s WHERE EXISTS (SELECT 1 FROM acts a WHERE a.kind <> 'add' AND a.image_id = s.image_id AND a.tile_idx = s.tile_idx)),
    j AS (SELECT d.*, coalesce(rejected, false) AS rj, coalesce({missed}, false) AS ms, adj, unsure, conf FROM dets d LEFT JOIN c2 USING (image_id, det_no) LEFT JOIN shown USING (image_id, det_no)),
    done AS (SELECT image_id, det_no, (CASE WHEN adj IS NOT NULL AND NOT rj AND NOT ms THEN adj.x ELSE x END)::INT AS x, (CASE WHEN adj IS NOT NULL AND NOT rj AND NOT ms THEN adj.y ELSE y END)::INT AS y,
      (CASE WHEN adj IS NOT NULL AND NOT rj AND NOT ms THEN adj.r ELSE radius END)::INT AS radius,
      CASE WHEN rj THEN 'rejected_non_tree' WHEN ms THEN 'rejected_unreviewed_by_repair' WHEN adj IS NOT NULL THEN 'adjusted_tree' WHEN unsure THEN 'kept_uncertain_non_tree' ELSE 'kept_by_repair' END AS llm_decision,
      (CASE WHEN adj IS NOT NULL AND NOT rj AND NOT ms THEN adj.c ELSE coalesce(conf, 0) END)::INT AS llm_confidence, CASE WHEN adj IS NOT NULL AND NOT rj AND NOT ms THEN 'llm_adjust' ELSE source END AS source, NULL::INT AS tile_idx, NULL::BIGINT AS pos FROM j
    UNION ALL SELECT image_id, NULL, gx::INT, gy::INT, radius::INT, 'added_tree', conf::INT, 'llm_add', tile_idx, pos FROM acts WHERE kind = 'add' AND conf >= 50 AND ok)"""


_DONE = "image_id, det_no, x, y, radius, llm_decision, llm_confidence, source"
_ITEMS = ", ".join(
    f"""{k}s AS (SELECT image_id, tile_idx, answer, '{k}' AS kind, unnest(range(0, json_array_length(j, '$.{k}')::BIGINT)) AS i, j FROM obj WHERE json_type(j, '$.{k}') = 'ARRAY')""" for k in verdicts.ACTIONS
)
_WHOLE = "coalesce(round_even(CASE WHEN isfinite(try_cast(trim(json_extract_string(j, '$.' || kind || '[' || i || '].{0}')) AS DOUBLE)) THEN try_cast(trim(json_extract_string(j, '$.' || kind || '[' || i || '].{0}')) AS DOUBLE) END, 0)::BIGINT, {1})"
#: The actions in the answers.
ACTIONS_SQL = rf"""body AS (SELECT *, CASE WHEN regexp_extract(response_text, '(?s)```(?:json)?\s*(.*?)\s*```', 1) <> '' THEN regexp_extract(response_text, '(?s)```(?:json)?\s*(.*?)\s*```', 1) ELSE response_text END AS t FROM repair_raw),
obj AS (SELECT * FROM (SELECT image_id, tile_idx, answer, regexp_extract(t, '(?s)\{{.*\}}', 0) AS j FROM body) WHERE j <> '' AND json_valid(j)), {_ITEMS},
repair_actions AS (SELECT image_id, tile_idx, kind, {_WHOLE.format('id', -1)} AS det_no, {_WHOLE.format('x', -1)} AS x, {_WHOLE.format('y', -1)} AS y, {_WHOLE.format('radius', 0)} AS radius,
  least(100, greatest(0, {_WHOLE.format('confidence', 0)}))::INT AS confidence, answer * 1000 + i AS pos FROM ({" UNION ALL ".join(f"SELECT * FROM {k}s" for k in verdicts.ACTIONS)}))"""


def _repair(spark, d, strict):
    dets, actions, t = repair_inputs(spark, d)
    scope = tiles.in_tiles(dets, t).select("image_id", "tile_idx", "det_no")
    return verdicts.repair(dets, actions, scope, t, strict=strict).drop("tile_idx", "pos")


@query(with_views(f"WITH {_repair_ctes(False)} SELECT {_DONE} FROM done", "images", "crowns", "repair_actions"))
def l5_repair(spark, d):
    return _repair(spark, d, False)


@query(with_views(f"WITH {_repair_ctes(True)} SELECT {_DONE} FROM done", "images", "crowns", "repair_actions"))
def l5_repair_strict(spark, d):
    return _repair(spark, d, True)


@query(
    with_views(
        f"""WITH RECURSIVE {ACTIONS_SQL}, {_repair_ctes(False)},
    base AS (SELECT *, coalesce(det_no, 1000000000000 + tile_idx::BIGINT * 1000000000 + pos) AS idx, CASE source WHEN 'llm_adjust' THEN 5 WHEN 'llm_add' THEN 4 WHEN 'llm_keep' THEN 3 WHEN 'opencv' THEN 2 ELSE 0 END AS k FROM done WHERE NOT starts_with(llm_decision, 'rejected')),
    r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY k DESC, llm_confidence DESC, radius DESC, idx) AS rn FROM base),
    g AS (SELECT image_id, 0::BIGINT AS rn, []::STRUCT(x INT, y INT, radius INT, idx BIGINT)[] AS kept FROM r GROUP BY image_id
      UNION ALL SELECT g.image_id, r.rn, CASE WHEN len(list_filter(g.kept, lambda e: {_SAME.format(least=5.0, share=0.45, t=0.58)})) > 0 THEN g.kept
        ELSE list_append(g.kept, {{'x': r.x, 'y': r.y, 'radius': r.radius, 'idx': r.idx}}) END FROM g JOIN r ON r.image_id = g.image_id AND r.rn = g.rn + 1),
    kept AS (SELECT g.image_id, unnest(g.kept).idx AS idx FROM g JOIN (SELECT image_id, max(rn) AS m FROM r GROUP BY image_id) l ON l.image_id = g.image_id AND l.m = g.rn)
    SELECT b.image_id, row_number() OVER (PARTITION BY b.image_id ORDER BY b.y, b.x, b.idx)::INT AS id, b.x, b.y, b.radius, llm_decision, llm_confidence, source FROM kept JOIN base b ON b.image_id = kept.image_id AND b.idx = kept.idx""",
        "images",
        "crowns",
        "repair_raw",
    )
)
def l5_from_answers(spark, d):
    """The whole repair: from the texts of a model's answers to numbered detections without duplicates."""
    dets, _, t = repair_inputs(spark, d)
    scope = tiles.in_tiles(dets, t).select("image_id", "tile_idx", "det_no")
    return verdicts.repaired(dets, view(spark, d, "repair_raw"), scope, t)
