"""The registered queries of this package: each operator over its whole table."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from clanmark.llm import backoff_language, code_negatives, kneser_ney, piece_bpe, reply_trees, threshold_centroids, voting
from clanmark.llm.base import query, table
from clanmark.llm.grace import exact_copies
from clanmark.llm.packing import pack_documents
from clanmark.llm.pivot_search import scaled, top_inner_products
from clanmark.llm.probminhash import near_classes
from clanmark.llm.shards import kd_shards
from clanmark.llm.winnowing import drop_repeated_runs
from clanmark.sources.workspace import materialize


@query("op1_kd_shards")
def op1_kd_shards(spark, folder):
    placed = kd_shards(table(spark, folder, "documents"), shards=16)
    none = F.lit(None).cast("int")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", none.alias("grown_shard")
    )


@query(
    "op2_pivot_topk",
    """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS i FROM e),
s AS (SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score FROM u q JOIN u c ON q.i = c.i
    WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id GROUP BY ALL),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
""",
)
def op2_pivot_topk(spark, folder):
    vectors = table(spark, folder, "embeddings").select("vec_id", scaled("embedding").alias("vector"))
    return top_inner_products(vectors, F.col("vec_id") % 100 == 0, k=10)


@query("op3_neighbour_voting")
def op3_neighbour_voting(spark, folder):
    return voting.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op4_kneser_ney")
def op4_kneser_ney(spark, folder):
    scored = kneser_ney.corpus_scores(table(spark, folder, "documents"), order=kneser_ney.ORDER)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query(
    "op5_reply_trees",
    r"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
w AS (SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;') AS t FROM c),
m AS (SELECT *, CASE role WHEN 'user' THEN length('[INST] [/INST]') WHEN 'assistant' THEN length('<s></s>')
    ELSE length('<<SYS>><</SYS>>') + length(role) + 1 END AS marks FROM w)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(length(t) + marks)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
""",
)
def op5_reply_trees(spark, folder):
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    kind = "conv_id long, turn long, role string, text string"
    more = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], kind)
    messages = materialize(reply_trees.linear(turns.unionByName(more)), "messages")
    return reply_trees.digests(messages, unique=True)  # numbered by turn


@query("op6_residual_packing")
def op6_residual_packing(spark, folder):
    return pack_documents(table(spark, folder, "documents"))


@query("op7_winnowed_lines")
def op7_winnowed_lines(spark, folder):
    cleaned = drop_repeated_runs(table(spark, folder, "documents"))
    return cleaned.select("doc_id", "text", "deleted", F.size("deleted").alias("n_deleted"))


@query("op8_probminhash")
def op8_probminhash(spark, folder):
    classes = near_classes(table(spark, folder, "documents"))
    return classes.select("doc_id", "class_id", "class_size", "n_texts", "kept")


@query("op9_piece_bpe")
def op9_piece_bpe(spark, folder):
    return piece_bpe.digests(table(spark, folder, "documents"))


@query(
    "op10_grace_dedup",
    r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
r AS (SELECT doc_id, t, count(*) OVER (PARTITION BY t) AS group_size,
    first_value(doc_id) OVER (PARTITION BY t ORDER BY chars DESC, doc_id) AS keep_id,
    row_number() OVER (PARTITION BY t ORDER BY chars DESC, doc_id) = 1 AS kept FROM n)
SELECT doc_id, keep_id, group_size, kept, sha256(t) AS text_sha256 FROM r
""",
)
def op10_grace_dedup(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return exact_copies(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _rounds_sql(rounds: int) -> str:
    """The rounds of ``op12`` one after the other; a0 holds the rows of the first centroids."""
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""d{n} AS MATERIALIZED (SELECT v.row, c.number, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS distance
    FROM u v JOIN c{n} c ON v.i = c.i GROUP BY ALL),
a{n} AS MATERIALIZED (SELECT row, number, distance FROM
    (SELECT *, row_number() OVER (PARTITION BY row ORDER BY distance, number) AS place FROM d{n}) WHERE place = 1)""")
        if n < rounds:
            steps.append(f"""m{n} AS (SELECT number, i, sum(x) AS s, count(*) AS n FROM u JOIN a{n} USING (row) GROUP BY ALL),
c{n + 1} AS MATERIALIZED (SELECT c.number, c.i, coalesce((s - (s % n + n) % n) // n, c.x)::BIGINT AS x
    FROM c{n} c LEFT JOIN m{n} m ON c.number = m.number AND c.i = m.i)""")
    return ",\n".join(steps)


@query(
    "op11_code_negatives",
    """
WITH e AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, label, len(v) AS n, unnest(v) AS x, unnest(range(len(v))) AS i FROM e),
s AS (SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, sum(q.x * c.x)::BIGINT AS score
    FROM u q JOIN u c ON q.i = c.i AND q.n = c.n WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id GROUP BY ALL),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score,
        row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
""",
)
def op11_code_negatives(spark, folder):
    return code_negatives.mined(table(spark, folder, "embeddings"))


@query(
    "op12_threshold_centroids",
    f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row, vec_id,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS MATERIALIZED (SELECT row, unnest(v) AS x, unnest(range(64)) AS i FROM e),
f AS (SELECT v, row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR), v) - 1 AS number FROM e WHERE vec_id IS NOT NULL),
c0 AS MATERIALIZED (SELECT number, unnest(v) AS x, unnest(range(64)) AS i FROM f WHERE number < 40),
{_rounds_sql(5)},
h AS (SELECT number, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c5 GROUP BY number)
SELECT vec_id, number::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY number)::BIGINT AS cluster_inertia,
    sum(distance) OVER ()::BIGINT AS inertia, centroid_sha256
FROM a5 JOIN e USING (row) JOIN h USING (number)
""",
)
def op12_threshold_centroids(spark, folder):
    return threshold_centroids.clusters(table(spark, folder, "embeddings"))


@query("op13_backoff_language")
def op13_backoff_language(spark, folder):
    return backoff_language.languages(table(spark, folder, "documents"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, folder):
    return corpus_pipeline.run(spark, folder)
