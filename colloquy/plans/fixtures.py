"""Views over the supplied tables that stand for the conversation schema.

One SQL text serves both engines: Spark reads it with the tables as CTEs over
Parquet, an oracle carries it in its own WITH.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {
    "recordings_v": """SELECT o_orderkey AS recording_id, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE concat('Order ', o_orderpriority) END AS title, o_orderdate AS created_at,
        CASE o_orderstatus WHEN 'O' THEN 'uploading' WHEN 'P' THEN 'processing' ELSE 'ready' END AS status, split(concat(lower(o_orderpriority), ',', o_orderstatus), ',') AS tags FROM orders""",
    "segments_v": """SELECT l_orderkey AS recording_id, l_linenumber AS seq, CAST(floor(l_quantity) AS BIGINT) * 1000 AS duration_ms, l_shipdate AS uploaded_at,
        CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS transcribed_at, l_partkey AS part, l_suppkey AS supp, l_extendedprice AS price FROM lineitem""",
    "speakers_v": """SELECT s.s_suppkey AS speaker_id, s.s_name AS display_name, CASE WHEN s.s_suppkey % 9 = 0 THEN NULL ELSE e.embedding END AS embedding
        FROM (SELECT *, s_suppkey % (SELECT count(*) FROM embeddings) AS vec FROM supplier) s LEFT JOIN embeddings e ON e.vec_id = s.vec""",
    "recording_speakers_v": """SELECT l_orderkey AS recording_id, l_linenumber AS local_idx, CASE WHEN min(l_suppkey) % 4 = 0 THEN NULL ELSE min(l_suppkey) END AS speaker_id
        FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "utterances_v": """SELECT conv_id * 1000 + turn AS utterance_id, conv_id AS recording_id, CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 END AS local_idx, turn * 20000 AS start_ms,
        turn * 20000 + CASE WHEN turn % 5 = 4 THEN 0 ELSE 500 + length(text) * 20 END AS end_ms, text FROM conversations""",
    "chunks_v": """SELECT d.doc_id AS chunk_id, d.doc_id AS recording_id, d.doc_id * 1000 AS start_ms, d.doc_id * 1000 + d.n_chars AS end_ms, d.text,
        CASE WHEN d.doc_id % 17 = 0 THEN NULL ELSE e.embedding END AS embedding FROM (SELECT *, doc_id % (SELECT count(*) FROM embeddings) AS vec FROM documents) d JOIN embeddings e ON e.vec_id = d.vec""",
    "jobs_v": """SELECT event_id AS job_id, user_id AS recording_id,
        CASE event_id % 7 WHEN 0 THEN 'transcode' WHEN 1 THEN 'diarize' WHEN 2 THEN 'transcribe' WHEN 3 THEN 'merge' WHEN 4 THEN 'embed' WHEN 5 THEN 'summarize' ELSE 'transcribe_segment' END AS kind,
        CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'done' END AS state, event_id % 3 AS priority, event_id % 5 AS attempts, ts AS created_at,
        CASE WHEN event_type = 'click' THEN ts END AS locked_at, props AS payload FROM events""",
    "words_v": """SELECT CAST(floor(event_id / 200.0) AS BIGINT) AS recording_id, event_id % 200 AS word_ord, event_type AS w,
        (event_id % 200) * 1600 + (CAST(floor(value) AS BIGINT) * 7) % 1500 AS start_ms,
        (event_id % 200) * 1600 + (CAST(floor(value) AS BIGINT) * 7) % 1500 + 100 + CAST(floor(value) AS BIGINT) % 700 AS end_ms FROM events""",
    "turns_v": """SELECT CAST(floor(event_id / 200.0) AS BIGINT) AS recording_id, event_id % 200 AS turn_ord, CAST(floor((event_id % 200) / 4.0) AS BIGINT) % 3 AS local_idx,
        (event_id % 200) * 1600 AS start_ms, (event_id % 200) * 1600 + 5200 AS end_ms FROM events WHERE event_id % 4 = 0 AND event_id % 20 <> 16""",
    # words cut into turns of forty, so that most turns are longer than one retrieval window
    "long_words_v": """SELECT recording_id, CAST(floor(word_ord / 40.0) AS BIGINT) AS utterance_no, word_ord, w, start_ms, end_ms FROM words_v""",
    "marks_v": """SELECT recording_id, start_ms + 250 AS mark_ms FROM words_v WHERE word_ord % 37 = 5""",
    "schedule_v": """SELECT 0 AS day, TRUE AS enabled, 540 AS start_min, 1020 AS end_min UNION ALL SELECT 1, TRUE, 1320, 360 UNION ALL SELECT 2, TRUE, 360, 600 UNION ALL SELECT 3, FALSE, 540, 1020
        UNION ALL SELECT 4, TRUE, 0, 0 UNION ALL SELECT 5, TRUE, 0, 60 UNION ALL SELECT 6, FALSE, 0, 0""",
}


def _needs(name: str) -> list[str]:
    """Views that a view is made of, in order, itself last."""
    out = []
    for other in VIEWS:
        if other != name and re.search(rf"\b{other}\b", VIEWS[name]):
            out += [x for x in _needs(other) if x not in out]
    return [*out, name]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    needs = _needs(name)
    used = [t for t in TABLES if any(re.search(rf"\b{t}\b", VIEWS[v]) for v in needs)]
    ctes = [f"{t} AS (SELECT * FROM parquet.`{sf_dir}/{t}.parquet`)" for t in used] + [f"{v} AS ({VIEWS[v]})" for v in needs]
    return spark.sql(f"WITH {', '.join(ctes)} SELECT * FROM {name}")


def oracle(select: str, **ctes: str) -> str:
    """DuckDB SQL: the views that ``select`` and ``ctes`` use, then ``ctes``, then ``select``."""
    text, needs = " ".join([*ctes.values(), select]), []
    for name in VIEWS:
        if re.search(rf"\b{name}\b", text):
            needs += [x for x in _needs(name) if x not in needs]
    parts = [f"{v} AS ({VIEWS[v]})" for v in needs] + [f"{k} AS ({v})" for k, v in ctes.items()]
    return f"WITH {', '.join(parts)} {select}" if parts else select
