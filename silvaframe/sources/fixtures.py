"""Views of the driver's tables that stand for detections, images, pixels, verdicts and edits.

Each text is plain SQL that any engine reads alike; integer arithmetic only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "crowns": """SELECT CAST(user_id AS BIGINT) AS image_id, CAST(event_id AS BIGINT) AS idx,
       CAST((event_id * 7919) % 640 AS INT) AS x, CAST((event_id * 104729) % 480 AS INT) AS y,
       CAST(8 + (event_id * 31 + user_id * 17) % 51 AS INT) AS radius,
       CAST(60 + (event_id * 53) % 4000 AS DOUBLE) AS area_px,
       CAST((event_id * 13) % 1000 AS DOUBLE) / 1000 AS circularity,
       CAST((event_id * 29) % 1000 AS DOUBLE) / 1000 AS fill_ratio,
       CAST((event_id * 37) % 10000 AS DOUBLE) / 10000 AS conf,
       CASE event_type WHEN 'click' THEN 'reference' WHEN 'view' THEN 'recall' WHEN 'purchase' THEN 'residual'
                       WHEN 'signup' THEN 'peak' ELSE 'manual' END AS source
FROM events""",
    "images": """SELECT CAST(n_nationkey AS BIGINT) AS image_id, concat('IMG_', lpad(CAST(n_nationkey AS VARCHAR(10)), 4, '0')) AS stem,
       CAST(500 + (n_nationkey * 397) % 5200 AS INT) AS width, CAST(400 + (n_nationkey * 251) % 3400 AS INT) AS height
FROM nation""",
    "pixels": """SELECT image_id, x, y,
       CAST(30 + ((u + 2) % 4) * 35 + (x * 11 + y) % 17 AS INT) AS b,
       CAST(40 + (u % 3) * 70 + (x * 7 + y * 13 + image_id * 5) % 23 AS INT) AS g,
       CAST(50 + ((u + 1) % 3) * 50 + (x * 3 + y * 5) % 19 AS INT) AS r
FROM (SELECT image_id, x, y, CAST(floor(x / 8) + floor(y / 8) AS BIGINT) + image_id AS u
      FROM (SELECT CAST(floor(event_id / 1000) AS BIGINT) AS image_id, CAST(event_id % 40 AS INT) AS x, CAST(floor((event_id % 1000) / 40) AS INT) AS y
            FROM events) p0) p1""",
    "site_pixels": """SELECT image_id, x, y,
       CAST(CASE k WHEN 0 THEN 190 + t % 40 WHEN 4 THEN 20 + t % 13 WHEN 7 THEN 140 + t % 9 WHEN 2 THEN 90 + t % 11 ELSE 30 + t % 25 END AS INT) AS b,
       CAST(CASE k WHEN 0 THEN 195 + t % 37 WHEN 4 THEN 60 + t % 17 WHEN 7 THEN 145 + t % 7 WHEN 2 THEN 110 + t % 13 ELSE 110 + t % 31 END AS INT) AS g,
       CAST(CASE k WHEN 0 THEN 192 + t % 41 WHEN 4 THEN 225 + t % 19 WHEN 7 THEN 143 + t % 8 WHEN 2 THEN 130 + t % 17 ELSE 60 + t % 23 END AS INT) AS r
FROM (SELECT image_id, x, y, (x * 7 + y * 13 + image_id) AS t, (CAST(floor(x / 7) AS BIGINT) * 5 + CAST(floor(y / 6) AS BIGINT) * 3 + image_id) % 9 AS k
      FROM (SELECT CAST(floor(event_id / 1000) AS BIGINT) AS image_id, CAST(event_id % 40 AS INT) AS x, CAST(floor((event_id % 1000) / 40) AS INT) AS y
            FROM events) p0) p1""",
    "verdicts_raw": """SELECT CAST(user_id AS BIGINT) AS image_id, CAST(event_id AS BIGINT) AS id,
       CASE WHEN event_id % 11 = 0 THEN '[{"id": 1, "is_tree": tru'
            WHEN event_id % 7 = 0 THEN concat('Result:', chr(10), '```json', chr(10), '[{"id": ', CAST(event_id AS VARCHAR(20)), ', "is_tree": "yes", "species": "oak", "confidence": "77"}]', chr(10), '```')
            WHEN event_id % 5 = 0 THEN concat('[{"id": ', CAST(event_id AS VARCHAR(20)), ', "is_tree": false, "confidence": ', CAST(event_id % 130 AS VARCHAR(20)), '}]')
            ELSE concat('[{"id": ', CAST(event_id AS VARCHAR(20)), ', "is_tree": true, "species": "pine", "confidence": ', CAST(event_id % 101 AS VARCHAR(20)), '.5}]') END AS response_text
FROM events WHERE event_id % 13 <> 0""",
    "repair_raw": """SELECT CAST(user_id AS BIGINT) AS image_id, CAST(event_id % 6 AS INT) AS tile_idx, CAST(event_id AS BIGINT) AS answer,
       CASE WHEN event_id % 11 = 0 THEN 'I found {no list' WHEN event_id % 13 = 0 THEN '[]'
            WHEN event_id % 3 = 0 THEN concat('Done.', chr(10), '```json', chr(10), '{"keep": [{"id": ', CAST((event_id * 3) % 40 AS VARCHAR(20)), ', "confidence": "', CAST(event_id % 101 AS VARCHAR(20)),
                 '"}], "adjust": [{"id": "', CAST((event_id * 7) % 40 AS VARCHAR(20)), '", "x": ', CAST((event_id * 17) % 300 AS VARCHAR(20)), '.5, "y": ', CAST((event_id * 19) % 260 AS VARCHAR(20)), ', "radius": ', CAST((event_id * 23) % 95 AS VARCHAR(20)), ', "confidence": ', CAST((event_id * 41) % 120 AS VARCHAR(20)), '}]}', chr(10), '```')
            WHEN event_id % 3 = 1 THEN concat('{"reject": [{"id": ', CAST((event_id * 5) % 40 AS VARCHAR(20)), ', "confidence": ', CAST((event_id * 13) % 101 AS VARCHAR(20)), '}, {"id": "none"}], "add": "nothing"}')
            ELSE concat('{"keep": [], "add": [{"x": ', CAST((event_id * 17) % 300 AS VARCHAR(20)), ', "y": ', CAST((event_id * 19) % 260 AS VARCHAR(20)), ', "radius": "', CAST((event_id * 23) % 95 AS VARCHAR(20)), '", "confidence": ', CAST((event_id * 41) % 101 AS VARCHAR(20)), '}]}') END AS response_text
FROM events""",
    "repair_actions": """SELECT CAST(user_id AS BIGINT) AS image_id, CAST(event_id AS BIGINT) AS pos, CAST(event_id % 6 AS INT) AS tile_idx,
       CASE event_id % 4 WHEN 0 THEN 'keep' WHEN 1 THEN 'reject' WHEN 2 THEN 'adjust' ELSE 'add' END AS kind,
       CAST((event_id * 3) % 40 AS BIGINT) AS det_no, CAST((event_id * 17) % 300 AS INT) AS x, CAST((event_id * 19) % 260 AS INT) AS y,
       CAST((event_id * 23) % 95 AS INT) AS radius, CAST((event_id * 41) % 101 AS INT) AS confidence
FROM events""",
    "edits": """SELECT CAST(user_id AS BIGINT) AS image_id, ts, CAST(event_id AS BIGINT) AS seq, CAST((event_id * 7) % 30 AS BIGINT) AS label_no,
       CASE event_type WHEN 'click' THEN 'add' WHEN 'error' THEN 'delete' WHEN 'view' THEN 'move' ELSE 'radius' END AS op,
       CAST((event_id * 11) % 640 AS INT) AS x, CAST((event_id * 5) % 480 AS INT) AS y, CAST(event_id % 9 - 4 AS INT) AS delta
FROM events""",
}
_TABLES = ("events", "nation")

# Crowns around the points of a grid of 20 pixels, each a little off its point, of 7 to 11 pixels' radius, so that some grow
# into each other; here and there a pixel shows the ground. Each event gives four pixels of an image of 80 x 50.
_PLACES = " UNION ALL ".join(f"SELECT CAST(floor(event_id / 1000) AS BIGINT) AS image_id, CAST((event_id % 40) * 2 + {dx} AS INT) AS x, CAST(floor((event_id % 1000) / 40) * 2 + {dy} AS INT) AS y FROM events" for dx in (0, 1) for dy in (0, 1))
_NEAR = " OR ".join(
    f"(x - 20 * (i + {di}) - ((i + {di}) * 7 + (j + {dj}) * 13 + image_id * 5) % 7 + 3) * (x - 20 * (i + {di}) - ((i + {di}) * 7 + (j + {dj}) * 13 + image_id * 5) % 7 + 3)"
    f" + (y - 20 * (j + {dj}) - ((i + {di}) * 11 + (j + {dj}) * 3 + image_id) % 5 + 2) * (y - 20 * (j + {dj}) - ((i + {di}) * 11 + (j + {dj}) * 3 + image_id) % 5 + 2)"
    f" <= (7 + ((i + {di}) * 5 + (j + {dj}) * 3 + image_id) % 5) * (7 + ((i + {di}) * 5 + (j + {dj}) * 3 + image_id) % 5)"
    for di in (0, 1)
    for dj in (0, 1)
)
VIEWS["canopy"] = f"""SELECT image_id, x, y, CAST(CASE WHEN k THEN 40 + t % 20 ELSE 100 + t % 9 END AS INT) AS b, CAST(CASE WHEN k THEN 110 + (t * 7) % 50 ELSE 120 + t % 7 END AS INT) AS g, CAST(CASE WHEN k THEN 60 + (t * 3) % 25 ELSE 150 + t % 11 END AS INT) AS r
FROM (SELECT image_id, x, y, ({_NEAR}) AND (x * 5 + y * 11 + image_id) % 29 <> 0 AS k, (x * 17 + y * 31 + x * y + image_id * 3) AS t
      FROM (SELECT image_id, x, y, CAST(floor(x / 20) AS BIGINT) AS i, CAST(floor(y / 20) AS BIGINT) AS j FROM ({_PLACES}) q0) q1) q2"""


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named view over the tables in a directory; nothing is registered in the session."""
    text = VIEWS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if f"FROM {t}" in text}
    text = text.replace("{", "{{").replace("}", "}}")
    for t in used:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(text, **used)


def with_views(sql: str, *names: str) -> str:
    """SQL that sees the named views."""
    if not names:
        return sql
    views = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    head, _, rest = sql.strip().partition(" ")
    if head.upper() == "WITH":
        if rest.upper().startswith("RECURSIVE"):
            return f"WITH RECURSIVE {views}, {rest[len('RECURSIVE '):]}"
        return f"WITH {views}, {rest}"
    return f"WITH {views} {sql}"
