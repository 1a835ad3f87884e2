"""Queries over answers of a model that is asked from Spark. A stand-in answers by arithmetic and fails now and then."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from silvaframe.operators import calls, candidates, verdicts
from silvaframe.plans.registry import query
from silvaframe.plans.scratch import shared_dir
from silvaframe.sources.fixtures import view, with_views


def stand_in(request: str, attempt: int) -> str:
    """Verdicts on the ids of a batch; some batches are never answered, some not at first."""
    asked = json.loads(request)
    mark = asked["image"] + asked["batch"]
    if mark % 7 == 0 or (mark + attempt) % 3 == 0:
        raise TimeoutError(f"no answer to batch {asked['batch']}")
    found = [{"id": i, "is_tree": i % 5 != 0, "species": "oak" if i % 2 else "pine", "confidence": i % 101} for i in asked["ids"]]
    return f"Here you are:\n```json\n{json.dumps(found)}\n```"


def batches(spark, d):
    """(key, image_id, ids, request): candidates of an image in batches of nine."""
    by = candidates.batches(view(spark, d, "crowns").select("image_id", "idx"), 9).groupBy("image_id", "batch").agg(F.sort_array(F.collect_list("idx")).alias("ids"))
    request = F.to_json(F.struct(F.col("image_id").alias("image"), F.col("batch").alias("batch"), F.col("ids").alias("ids")))
    return by.select(F.concat_ws(":", "image_id", "batch").alias("key"), "image_id", "batch", "ids", request.alias("request"))


_BATCHES = "placed AS (SELECT image_id, idx, (row_number() OVER (PARTITION BY image_id ORDER BY idx) - 1) // 9 AS batch FROM crowns), marked AS (SELECT *, image_id + batch AS mark FROM placed)"
_TRIES = "CASE WHEN mark % 7 = 0 THEN 3 WHEN (mark + 1) % 3 = 0 THEN 2 ELSE 1 END"


@query(with_views(f"WITH {_BATCHES} SELECT image_id, batch, count(*) AS n, any_value({_TRIES})::INT AS attempts, any_value(mark % 7 <> 0) AS ok FROM marked GROUP BY image_id, batch", "crowns"))
def l3_calls(spark, d):
    """How often each batch was asked about, and whether it was answered."""
    out = calls.answered(batches(spark, d), stand_in, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}", pause=lambda s: None)
    return out.select("image_id", F.col("batch").cast("long").alias("batch"), F.size("ids").cast("long").alias("n"), "attempts", F.col("answer").isNotNull().alias("ok"))


@query(
    with_views(
        f"""WITH {_BATCHES}, v AS (SELECT image_id, idx, CASE WHEN mark % 7 = 0 THEN true ELSE idx % 5 <> 0 END AS is_tree, CASE WHEN mark % 7 = 0 THEN '未知' WHEN idx % 2 = 1 THEN 'oak' ELSE 'pine' END AS species, CASE WHEN mark % 7 = 0 THEN 0 ELSE idx % 101 END::INT AS llm_confidence FROM marked)
    SELECT *, CASE WHEN is_tree AND llm_confidence < 50 THEN 'kept_low_confidence_tree' WHEN is_tree THEN 'verified_tree' WHEN llm_confidence < 70 THEN 'kept_uncertain_non_tree' ELSE 'rejected_non_tree' END AS llm_decision FROM v""",
        "crowns",
    )
)
def l3_verified(spark, d):
    """Detections with the verdicts of the model that was asked; those of batches without an answer are kept as unsure."""
    out = calls.answered(batches(spark, d), stand_in, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}", pause=lambda s: None)
    told = out.where("answer is not null").select("image_id", F.col("batch").alias("id"), F.col("answer").alias("response_text"))
    return verdicts.verify(view(spark, d, "crowns").select("image_id", "idx"), told).select("image_id", "idx", "is_tree", "species", "llm_confidence", "llm_decision")
