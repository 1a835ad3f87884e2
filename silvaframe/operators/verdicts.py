"""A model's verdicts on detections: parsing, joining, deciding, and repair by tiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silvaframe.functions import conflicts
from silvaframe.functions.rules import REPAIR_RANK, UNKNOWN_SPECIES, case_of, coerce_bool, coerce_confidence, tile_to_global, whole_number
from silvaframe.operators.suppress import renumber, suppress

VERDICT = "array<struct<id:string,is_tree:string,species:string,confidence:string>>"
_ACTION = "array<struct<id:string,x:string,y:string,radius:string,confidence:string>>"
#: Kinds of repair in the order in which a tile's answer is gone through.
ACTIONS = ("keep", "reject", "adjust", "add")


def json_array(text: Column) -> Column:
    """The JSON array in an answer: the body of a fenced block if there is one, from the first [ to the last ]."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(fenced != "", fenced).otherwise(text)
    return F.regexp_extract(body, r"(?s)\[.*\]", 0)


def parse(responses: DataFrame) -> DataFrame:
    """(image_id, id, is_tree, species, llm_confidence): the verdicts in each answer; the last on an id counts.

    An answer that is no JSON array gives none. Unknown words for yes and no count as yes.
    """
    items = responses.withColumn("v", F.from_json(json_array(F.col("response_text")), VERDICT)).select("image_id", F.col("id").alias("answer"), F.posexplode("v").alias("pos", "v"))
    items = items.withColumn("vid", F.col("v.id").try_cast("long")).where("vid is not null")
    last = items.groupBy("image_id", F.col("vid").alias("id")).agg(F.max_by("v", F.struct("answer", "pos")).alias("v"))
    return last.select("image_id", "id", coerce_bool(F.col("v.is_tree"), True).alias("is_tree"), F.coalesce(F.nullif(F.col("v.species"), F.lit("")), F.lit(UNKNOWN_SPECIES)).alias("species"), coerce_confidence(F.col("v.confidence")).alias("llm_confidence"))


def decide(is_tree: Column, confidence: Column, least: int, reject: int, conservative: bool = True) -> Column:
    keep = (confidence < reject) if conservative else F.lit(False)
    return F.when(is_tree & (confidence < least), "kept_low_confidence_tree").when(is_tree, "verified_tree").when(keep, "kept_uncertain_non_tree").otherwise("rejected_non_tree")


def verify(detections: DataFrame, responses: DataFrame, least: int = 50, reject: int = 70, conservative: bool = True) -> DataFrame:
    """Detections (image_id, idx) with their verdicts and llm_decision; without a verdict a row is kept as unsure."""
    v = parse(responses).withColumnRenamed("id", "idx")
    out = detections.join(v, ["image_id", "idx"], "left")
    out = out.withColumn("is_tree", F.coalesce("is_tree", F.lit(True))).withColumn("species", F.coalesce("species", F.lit(UNKNOWN_SPECIES))).withColumn("llm_confidence", F.coalesce("llm_confidence", F.lit(0)))
    return out.withColumn("llm_decision", decide(F.col("is_tree"), F.col("llm_confidence"), least, reject, conservative))


def parse_actions(responses: DataFrame) -> DataFrame:
    """(image_id, tile_idx, kind, det_no, x, y, radius, confidence, pos): the actions in answers (image_id, tile_idx, answer, response_text).

    The body of a fenced block if there is one, from the first { to the last }, read as an object of four lists; a list
    that is none, or an answer that is no such object, gives no actions. pos orders the actions of a tile and kind.
    """
    text = F.col("response_text")
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    body = F.regexp_extract(F.when(fenced != "", fenced).otherwise(text), r"(?s)\{.*\}", 0)
    read = responses.withColumn("a", F.from_json(body, "struct<" + ",".join(f"{k}:{_ACTION}" for k in ACTIONS) + ">"))
    listed = lambda k: F.transform(F.coalesce(f"a.{k}", F.array().cast(_ACTION)), lambda v, i: F.struct(F.lit(k).alias("kind"), i.alias("i"), v.alias("v")))
    every = F.flatten(F.array(*map(listed, ACTIONS)))
    items = read.select("image_id", "tile_idx", "answer", F.explode(every).alias("e")).where("e.v is not null")
    number = lambda c, default: whole_number(F.col(f"e.v.{c}"), default)
    return items.select(
        "image_id", "tile_idx", "e.kind", number("id", -1).alias("det_no"), number("x", -1).alias("x"), number("y", -1).alias("y"), number("radius", 0).alias("radius"),
        coerce_confidence(F.col("e.v.confidence")).alias("confidence"), (F.col("answer") * 1000 + F.col("e.i")).alias("pos"),
    )


def repaired(detections: DataFrame, responses: DataFrame, scope: DataFrame, tiles: DataFrame, overlap: float = 0.58, widest_radius: int = 80, **options) -> DataFrame:
    """(image_id, id, x, y, radius, llm_decision, llm_confidence, source): from answers to numbered detections.

    Actions are parsed and applied (`repair`), rejected rows go, of rows that are the same tree the one of the better
    source, confidence and radius stays, and what is left is numbered by (y, x).
    """
    out = repair(detections, parse_actions(responses), scope, tiles, **options).where(~F.col("llm_decision").startswith("rejected"))
    first = F.coalesce("det_no", F.lit(10**12) + F.col("tile_idx").cast("long") * 10**9 + F.col("pos"))
    out = out.withColumn("idx", first.cast("long")).withColumn("_source", case_of(F.col("source"), REPAIR_RANK, 0))
    rank = [-F.col("_source"), -F.col("llm_confidence"), -F.col("radius"), F.col("idx")]
    kept = suppress(out, rank, conflicts.same_circle(5.0, 0.45, overlap), 2.0 * widest_radius + 2)
    return renumber(kept).select("image_id", "id", "x", "y", "radius", "llm_decision", "llm_confidence", "source")


def repair(detections: DataFrame, actions: DataFrame, scope: DataFrame, tiles: DataFrame, least: int = 50, reject: int = 70, conservative: bool = True, strict: bool = False, radius: tuple[int, int] = (5, 80)) -> DataFrame:
    """(image_id, det_no, x, y, radius, llm_decision, llm_confidence, source, tile_idx, pos): detections after tile repair, and
    added circles with their tile and place.

    detections (image_id, det_no, x, y, radius, source); actions (image_id, tile_idx, kind, det_no, x, y,
    radius, confidence, pos); scope (image_id, tile_idx, det_no): the candidates each tile was shown; tiles
    (image_id, tile_idx, tx, ty, tw, th). Within a tile keeps come first, then rejects, then adjusts, each
    in order; tiles go by number. A rejection by any tile wins; then, if strict, rows of an answered
    tile that nobody reviewed go; then the last valid adjustment counts.
    """
    order = F.when(F.col("kind") == "keep", 0).when(F.col("kind") == "reject", 1).otherwise(2)
    conf = F.least(F.lit(100), F.greatest(F.lit(0), F.col("confidence")))
    acts = actions.join(tiles, ["image_id", "tile_idx"]).withColumn("conf", conf).withColumn("at", F.struct("tile_idx", order.alias("k"), "pos"))
    circle = tile_to_global(tuple(F.col(c) for c in ("tx", "ty", "tw", "th")), F.col("x"), F.col("y"), F.col("radius"), *radius)
    acts = acts.withColumn("circle", circle)
    on = acts.where("kind <> 'add'").join(scope, ["image_id", "tile_idx", "det_no"], "left_semi")
    soft = (F.col("kind") == "reject") & (F.col("conf") < reject) if conservative else F.lit(False)
    hard = (F.col("kind") == "reject") & ~soft
    fit = (F.col("kind") == "adjust") & (F.col("conf") >= least)
    # confidence: a keep raises it, a reject sets it, in order of tiles; a fold over the sorted few actions of a row
    step = F.when(F.col("kind") == "keep", F.lit(0)).when(F.col("kind") == "reject", F.lit(1))
    per = on.groupBy("image_id", "det_no").agg(
        F.bool_or(hard).alias("rejected"),
        F.bool_or((F.col("kind") != "adjust") | fit).alias("reviewed"),
        F.bool_or(soft).alias("unsure"),
        F.max_by(F.struct("circle", "conf"), F.when(fit & F.col("circle").isNotNull(), F.col("at"))).alias("adjusted"),
        F.array_sort(F.collect_list(F.when(step.isNotNull(), F.struct("at", step.alias("step"), "conf")))).alias("marks"),
    )
    confidence = F.aggregate("marks", F.lit(0), lambda acc, m: F.when(m["step"] == 0, F.greatest(acc, m["conf"])).otherwise(m["conf"]))
    answered = on.select("image_id", "tile_idx").union(acts.where("kind <> 'add'").select("image_id", "tile_idx")).distinct()
    shown = scope.join(answered, ["image_id", "tile_idx"], "left_semi").select("image_id", "det_no").distinct().withColumn("shown", F.lit(True))
    out = detections.join(per, ["image_id", "det_no"], "left").join(shown, ["image_id", "det_no"], "left")
    rejected, moved = F.coalesce("rejected", F.lit(False)), F.col("adjusted.circle").isNotNull()
    missed = F.coalesce("shown", F.lit(False)) & ~F.coalesce("reviewed", F.lit(False)) if strict else F.lit(False)
    decision = F.when(rejected, "rejected_non_tree").when(missed, "rejected_unreviewed_by_repair").when(moved, "adjusted_tree").when(F.coalesce("unsure", F.lit(False)), "kept_uncertain_non_tree").otherwise("kept_by_repair")
    use = moved & ~rejected & ~missed
    pick = lambda c: F.when(use, F.col(f"adjusted.circle.{c}")).otherwise(F.col(c)).cast("int").alias(c)
    conf_out = F.when(use, F.col("adjusted.conf")).otherwise(F.coalesce(confidence, F.lit(0))).cast("int")
    out = out.select("image_id", "det_no", pick("x"), pick("y"), pick("radius"), decision.alias("llm_decision"), conf_out.alias("llm_confidence"), F.when(use, "llm_adjust").otherwise(F.col("source")).alias("source"), F.lit(None).cast("int").alias("tile_idx"), F.lit(None).cast("long").alias("pos"))
    added = acts.where((F.col("kind") == "add") & (F.col("conf") >= least) & F.col("circle").isNotNull())
    none = F.lit(None).cast("long")
    added = added.select("image_id", none.alias("det_no"), F.col("circle.x").cast("int").alias("x"), F.col("circle.y").cast("int").alias("y"), F.col("circle.radius").cast("int").alias("radius"), F.lit("added_tree").alias("llm_decision"), F.col("conf").cast("int").alias("llm_confidence"), F.lit("llm_add").alias("source"), F.col("tile_idx").cast("int").alias("tile_idx"), F.col("pos").cast("long").alias("pos"))
    return out.unionByName(added)


def species_counts(verified: DataFrame) -> DataFrame:
    """(species, trees, place): counts of kept rows, most frequent first, ties by first appearance."""
    kept = verified.where(~F.col("llm_decision").startswith("rejected"))
    counts = kept.groupBy("species").agg(F.count(F.lit(1)).alias("trees"), F.min("idx").alias("first"))
    return counts.select("species", "trees", F.row_number().over(Window.orderBy(F.desc("trees"), "first")).alias("place"))


def prompt_rows(detections: DataFrame) -> DataFrame:
    """(image_id, candidates): the table of candidates that a prompt shows, as JSON."""
    row = F.struct("idx", "x", "y", "radius")
    return detections.groupBy("image_id").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("candidates"))


def prompts(candidates: DataFrame, template: str) -> DataFrame:
    """Adds prompt to (image_id, tile_idx, tw, th, candidates): the template with {width}, {height} and {candidates} filled in."""
    text = F.lit(template)
    for name, value in (("{width}", F.col("tw").cast("string")), ("{height}", F.col("th").cast("string")), ("{candidates}", F.col("candidates"))):
        text = F.replace(text, F.lit(name), value)
    return candidates.withColumn("prompt", text)


def tile_candidates(detections: DataFrame, tiles: DataFrame) -> DataFrame:
    """(image_id, tile_idx, tw, th, candidates): the detections (image_id, det_no, x, y, radius, tile_idx, tx, ty) in each tile, in its own coordinates, as JSON."""
    row = F.struct(F.col("det_no").alias("id"), (F.col("x") - F.col("tx")).alias("x"), (F.col("y") - F.col("ty")).alias("y"), "radius")
    listed = detections.groupBy("image_id", "tile_idx").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("candidates"))
    return tiles.select("image_id", "tile_idx", "tw", "th").join(listed, ["image_id", "tile_idx"], "left").withColumn("candidates", F.coalesce("candidates", F.lit("[]")))


def circle_area(radius: Column) -> Column:
    return F.bround(math.pi * radius * radius, 2)
