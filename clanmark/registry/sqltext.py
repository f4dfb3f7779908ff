"""SQL counterparts of the inputs, as common table expressions for DuckDB.

``sql`` puts in front of a query the expressions that it names, in order.
"""

from __future__ import annotations

import re

from clanmark.registry.inputs import RUNS

EXPRESSIONS: dict[str, str] = {}


def define(name: str, text: str, columns: str = "", materialized: bool = True) -> None:
    EXPRESSIONS[name] = f"{name}{columns} AS {'MATERIALIZED ' if materialized else ''}({text})"


def _needs(text: str, own: str | None = None) -> set[str]:
    return {n for n in EXPRESSIONS if n != own and re.search(rf"\b{n}\b", text)}


def sql(query: str) -> str:
    wanted, todo = set(), list(_needs(query))
    while todo:
        name = todo.pop()
        if name not in wanted:
            wanted.add(name)
            todo.extend(_needs(EXPRESSIONS[name], name))
    if not wanted:
        return query.strip()
    parts = [text for name, text in EXPRESSIONS.items() if name in wanted]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + query.strip()


def unit(v: str) -> str:
    length = f"sqrt(list_sum(list_transform({v}, lambda q: q * q)))"
    return f"list_transform({v}, lambda z: z / {length})"


def components(name: str, vertices: str, edges: str) -> None:
    """``name``(id, component) over ``vertices``(id) and ``edges``(a, b)."""
    define(f"{name}_sym", f"SELECT a, b FROM ({edges}) UNION SELECT b, a FROM ({edges})")
    define(
        f"{name}_lab",
        f"SELECT id, id FROM ({vertices}) UNION "
        f"SELECT s.b, l.c FROM {name}_lab l JOIN {name}_sym s ON s.a = l.id WHERE l.c < s.b",
        "(id, c)",
        materialized=False,
    )
    define(name, f"SELECT id, min(c) AS component FROM {name}_lab GROUP BY id")


def mean_of(vector: str) -> str:
    """Element-wise mean over a group of 64-dimensional vectors."""
    return "[" + ", ".join(f"avg({vector}[{i}])" for i in range(1, 65)) + "]"


define("e", "SELECT vec_id AS i, embedding::DOUBLE[] AS v, label FROM embeddings")
define(
    "det_raw",
    """SELECT a.i AS detection_id,
  CASE WHEN (a.i // 10) % 5 = 0 THEN a.i // 10 + 1000 ELSE a.i * 7 % 60 END AS asset_id,
  0.4::DOUBLE + (a.i * 37 % 60) / 100.0::DOUBLE AS confidence,
  a.i * 13 % 90 + 20 AS w, a.i * 17 % 90 + 20 AS h, a.i * 5 % 400 AS x, a.i * 3 % 300 AS y,
  640 AS image_w, 480 AS image_h, a.i * 29 % 320 AS blur,
  list_transform(range(1, len(a.v) + 1), lambda k:
    (b.v[k] + (0.6::DOUBLE + 0.15::DOUBLE * ((a.i // 10) % 4)) * c.v[k])
    + (0.3::DOUBLE + 0.15::DOUBLE * (a.i % 3)) * a.v[k]) AS vector
FROM e a JOIN e b ON b.i = a.i // 10 * 10
JOIN e c ON c.i = a.i // 10 * 10 + (a.i % 10) // 4 * 4""",
)
define(
    "det",
    f"""SELECT *, 'photos' AS bucket, CASE WHEN asset_id % 2 = 0 THEN 'a' ELSE 'b' END AS sub_bucket,
  confidence * (w * h) AS quality, {unit('vector')} AS unit FROM det_raw""",
)
define(
    "pair",
    """SELECT a.detection_id AS a, b.detection_id AS b, list_cosine_similarity(a.unit, b.unit) AS s
FROM det a JOIN det b ON a.detection_id < b.detection_id""",
)
for _name, _t in (("comp75", "0.75"), ("comp85", "0.85")):
    components(_name, "SELECT detection_id AS id FROM det", f"SELECT a, b FROM pair WHERE s >= {_t}")
define(
    "profiles",
    """SELECT 'user_' || lpad((i // 20)::VARCHAR, 6, '0') AS user_id, i // 20 AS k, v AS embedding,
  0.5::DOUBLE + ((i // 20) % 50) / 100.0::DOUBLE AS confidence, (i // 20) * 1.5::DOUBLE AS quality_score,
  [((i // 20) * 3 % 300)::DOUBLE, ((i // 20) * 5 % 300)::DOUBLE, ((i // 20) * 7 % 300)::DOUBLE,
   ((i // 20) * 11 % 300)::DOUBLE] AS bbox
FROM (SELECT *, row_number() OVER (PARTITION BY i // 20 ORDER BY i) AS n FROM e) WHERE n = 1""",
)
define(
    "submitted",
    """SELECT k, CASE WHEN k % 7 = 1 THEN 'bad id ' || k WHEN k % 7 = 2 THEN 'x' ELSE user_id END AS user_id,
  CASE WHEN k % 5 = 1 THEN []::DOUBLE[] ELSE embedding END AS embedding,
  CASE WHEN k % 4 = 1 THEN 1.5::DOUBLE ELSE confidence END AS confidence,
  CASE WHEN k % 6 = 1 THEN -1.0::DOUBLE ELSE quality_score END AS quality_score,
  CASE WHEN k % 3 = 1 THEN bbox[1:3] ELSE bbox END AS bbox FROM profiles""",
)
define(
    "placed",
    " UNION ALL ".join(
        f"SELECT id AS detection_id, "
        + (
            "CASE WHEN count(*) OVER (PARTITION BY component) > 1 THEN component END"
            if singles_out
            else "component"
        )
        + f" AS cluster_id, '{name}' AS run, TIMESTAMP '{at}' AS ts FROM comp{round(t * 100)}"
        for name, t, at, singles_out in RUNS
    ),
)
define(
    "members_all",
    """SELECT p.run || d.sub_bucket AS run_id, d.bucket, d.sub_bucket, p.cluster_id, d.detection_id,
  d.asset_id, d.confidence, d.quality, d.blur, p.ts, d.unit,
  d.quality * 0.6::DOUBLE + d.confidence * 0.4::DOUBLE AS score
FROM placed p JOIN det d USING (detection_id)""",
)
define(
    "members",
    """SELECT *, cluster_id IS NOT NULL AND
  row_number() OVER (PARTITION BY run_id, cluster_id ORDER BY score DESC, detection_id) = 1 AS is_owner,
  coalesce(cluster_id::VARCHAR, 'unassigned') AS person_id FROM members_all""",
)
define(
    "clusters",
    """SELECT run_id, cluster_id, count(*) AS total_detections, count(DISTINCT asset_id) AS unique_assets,
  avg(confidence) AS avg_confidence, max(quality) AS best_quality, min(detection_id) AS first_id,
  max(CASE WHEN is_owner THEN detection_id END) AS owner_id
FROM members WHERE cluster_id IS NOT NULL GROUP BY ALL""",
)
define(
    "overlap",
    """SELECT run_id, count(*) FILTER (c = 1) AS single_cluster_assets, count(*) FILTER (c > 1) AS multi_cluster_assets,
  max(c) AS max_clusters_per_asset, avg(c) AS avg_clusters_per_asset
FROM (SELECT run_id, asset_id, count(DISTINCT cluster_id) AS c FROM members
      WHERE cluster_id IS NOT NULL GROUP BY ALL) GROUP BY run_id""",
)
define(
    "runs",
    """SELECT run_id, count(DISTINCT cluster_id) AS total_persons, count(DISTINCT asset_id) AS total_images,
  count(*) AS total_faces, count(*) FILTER (cluster_id IS NULL) AS unassigned_faces,
  min(bucket) AS bucket, min(sub_bucket) AS sub_bucket, min(ts) AS ts,
  any_value(o.single_cluster_assets) AS single_cluster_assets, any_value(o.multi_cluster_assets) AS multi_cluster_assets,
  any_value(o.max_clusters_per_asset) AS max_clusters_per_asset, any_value(o.avg_clusters_per_asset) AS avg_clusters_per_asset
FROM members JOIN overlap o USING (run_id) GROUP BY run_id""",
)
define(
    "scores",
    """SELECT c.run_id, c.cluster_id, c.total_detections, p.user_id, list_cosine_similarity(d.unit, p.embedding) AS s
FROM clusters c JOIN det d ON d.detection_id = c.owner_id CROSS JOIN profiles p""",
)
define(
    "assignments",
    """SELECT run_id, cluster_id, user_id, s AS similarity, 'centroid' AS strategy, total_detections AS face_count,
  'photos/' || run_id[3] AS bucket_path,
  TIMESTAMP '2024-02-03 00:00:00' + to_minutes(cluster_id) AS created_at
FROM (SELECT *, row_number() OVER (PARTITION BY run_id, cluster_id ORDER BY s DESC, user_id) AS n FROM scores)
WHERE n = 1 AND s >= 0.65""",
)
define(
    "asset_keys",
    """SELECT event_id, i * 7919 % 30000000 AS length,
  CASE i % 11 WHEN 3 THEN 'user-profiles/u' || i WHEN 4 THEN 'user-profiles/u' || i || '/face' || ext
   WHEN 5 THEN 'temp-uploads/s' || i || '/a/b' || ext WHEN 6 THEN 'lonely' || i
   WHEN 7 THEN '/anonymous-images/b' || i WHEN 8 THEN 'anonymous-images/batch_3/'
   ELSE 'anonymous-images/batch_' || (i % 7) || '/img_' || i || ext END AS key
FROM (SELECT event_id, event_id AS i,
  ['.jpg', '.JPEG', '.png', '.webp', '.txt', '.tiff', '/'][event_id % 7 + 1] AS ext FROM events)""",
)
define(
    "names",
    """SELECT event_id, user_id, event_type, ts,
  CASE event_id % 8 WHEN 0 THEN 'My Batch ' || event_id WHEN 1 THEN '__A__b__' || event_id || '__' WHEN 2 THEN ''
   WHEN 3 THEN 'café-' || event_id || '.PNG' WHEN 4 THEN '___' WHEN 5 THEN 'x.y.' || event_id || '.jpeg'
   WHEN 6 THEN 'user.' || user_id || '@site-' || event_id ELSE 'plain_' || event_id END AS name,
  CASE WHEN event_id % 3 = 0 THEN 'user' || user_id || '@example.org' END AS email FROM events""",
)
define(
    "plog",
    """SELECT event_id, user_id, value AS seconds,
  CASE event_type WHEN 'purchase' THEN 'processed' WHEN 'error' THEN 'failed' ELSE 'other' END AS status
FROM events""",
)
