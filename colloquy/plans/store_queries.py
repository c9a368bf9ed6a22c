"""Queries on what is stored for recordings: children, arriving segments, artifacts, edits, templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.json import parse_line_edits
from ..functions.vector import embedded
from ..operators import library, prompts, queue, rows
from ..sources import audio, schemas
from .fixtures import oracle, table, view
from .queries import NOW, _now, query


@query(oracle("SELECT recording_id, seq, duration_ms FROM segments_v WHERE recording_id = 7 ORDER BY seq, duration_ms"))
def recording_children(spark, d):
    return library.children(view(spark, d, "segments_v"), 7, ["seq", "duration_ms"]).select("recording_id", "seq", "duration_ms")


@query(
    oracle(
        """SELECT r.recording_id, r.title, coalesce(s.n, 0) AS n_segments, coalesce(j.n, 0) AS n_jobs, coalesce(v.n, 0) AS n_speakers FROM recordings_v r
           LEFT JOIN (SELECT recording_id, count(*) AS n FROM segments_v GROUP BY recording_id) s USING (recording_id)
           LEFT JOIN (SELECT recording_id, count(*) AS n FROM jobs_v GROUP BY recording_id) j USING (recording_id)
           LEFT JOIN (SELECT recording_id, count(*) AS n FROM recording_speakers_v GROUP BY recording_id) v USING (recording_id)"""
    )
)
def recording_details(spark, d):
    tables = {"segments": view(spark, d, "segments_v"), "jobs": view(spark, d, "jobs_v"), "speakers": view(spark, d, "recording_speakers_v")}
    return library.details(view(spark, d, "recordings_v").select("recording_id", "title"), tables)


def _files(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("recording_id"), F.col("turn").cast("int").alias("seq"), F.format_string("%d/segments/%d.m4a", "conv_id", "turn").alias("storage_key"), F.col("text").cast("binary").alias("content"))


@query(
    oracle(
        f"""SELECT c.conv_id AS recording_id, CAST(c.turn AS INTEGER) AS seq, concat(c.conv_id, '/segments/', c.turn, '.m4a') AS storage_key, CAST(strlen(c.text) AS BIGINT) AS bytes, sha256(c.text) AS sha256, TIMESTAMP '{NOW}' AS uploaded_at
            FROM conversations c JOIN recordings_v r ON r.recording_id = c.conv_id"""
    )
)
def segment_ingest(spark, d):
    got, _ = audio.received(_files(spark, d), view(spark, d, "recordings_v"), _now())
    # the first of them were there with other contents
    stored = got.where("seq = 0").withColumns({"bytes": F.lit(0).cast("long"), "sha256": F.lit("")})
    return rows.upsert(stored, got, ["recording_id", "seq"], ["storage_key", "bytes", "sha256", "uploaded_at"], _now())


@query(
    oracle(
        "SELECT recording_id, kind, state, count(*) AS n FROM (SELECT recording_id, kind, state FROM jobs_v UNION ALL SELECT DISTINCT c.conv_id, 'transcribe_segment', 'queued' FROM conversations c JOIN recordings_v r ON r.recording_id = c.conv_id WHERE r.status = 'uploading' AND NOT EXISTS (SELECT 1 FROM jobs_v j WHERE j.recording_id = c.conv_id AND j.kind = 'transcribe_segment' AND j.state IN ('queued', 'running'))) GROUP BY recording_id, kind, state"
    )
)
def segment_live_jobs(spark, d):
    _, wanted = audio.received(_files(spark, d), view(spark, d, "recordings_v"), _now())
    jobs = queue.enqueue(queue.as_jobs(view(spark, d, "jobs_v")).withColumn("priority", F.col("priority").cast("int")), wanted, _now())
    return jobs.groupBy("recording_id", "kind", "state").agg(F.count("*").alias("n"))


@query(oracle("SELECT conv_id AS recording_id, sha256(string_agg(text, '' ORDER BY turn)) AS sha256, CAST(sum(strlen(text)) // 2 * 1000 // 16000 AS BIGINT) AS duration_ms FROM conversations GROUP BY conv_id"))
def segment_samples(spark, d):
    return audio.joined_samples(_files(spark, d)).select("recording_id", F.sha2("content", 256).alias("sha256"), "duration_ms")


@query(oracle("SELECT conv_id AS recording_id, concat('turn', turn) AS kind, CASE WHEN turn % 2 = 0 THEN concat('new ', text) ELSE text END AS text FROM conversations"))
def artifact_round_trip(spark, d):
    own = table(spark, d, "conversations").select(F.col("conv_id").alias("recording_id"), F.concat(F.lit("turn"), "turn").alias("kind"), F.struct("text").alias("data"), "turn")
    stored = own.select("recording_id", "kind", F.to_json("data").alias("data"), _now().alias("updated_at"))
    fresh = own.where("turn % 2 = 0").select("recording_id", "kind", F.struct(F.concat(F.lit("new "), "data.text").alias("text")).alias("data"))
    stored = schemas.put_document(stored, ["recording_id", "kind"], fresh, "data", "updated_at", _now())
    return schemas.required_document(own, stored, ["recording_id", "kind"], "data", "struct<text:string>").select("recording_id", "kind", "data.text")


@query(oracle("SELECT n_nationkey AS chunk_id, n_name AS text FROM nation UNION ALL SELECT 20 + s_suppkey, s_name FROM supplier WHERE 20 + s_suppkey NOT IN (SELECT n_nationkey FROM nation)"))
def insert_absent_rows(spark, d):
    stored = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("chunk_id"), F.col("n_name").alias("text"))
    return rows.insert_absent(stored, table(spark, d, "supplier").select((20 + F.col("s_suppkey")).alias("chunk_id"), F.col("s_name").alias("text")), ["chunk_id"])


@query(oracle("SELECT utterance_id, CASE utterance_id % 3 WHEN 0 THEN trim(concat('New ', text)) ELSE text END AS text FROM utterances_v"))
def edit_texts(spark, d):
    said = view(spark, d, "utterances_v").select("utterance_id", "text")
    edits = said.where("utterance_id % 3 < 2").select("utterance_id", F.when(F.col("utterance_id") % 3 == 0, F.concat(F.lit(" New "), "text")).otherwise("  ").alias("new_text"))
    return rows.edit_text(said, edits)


@query(oracle("SELECT recording_id, local_idx, CASE WHEN recording_id = 7 AND local_idx = 1 THEN NULL ELSE speaker_id END AS speaker_id FROM recording_speakers_v"))
def unname_speaker(spark, d):
    return rows.unname_speaker(view(spark, d, "recording_speakers_v"), 7, 1)


@query(
    oracle(
        r"SELECT recording_id, string_agg(concat(n, ': ', t), chr(10) ORDER BY n) AS lines FROM (SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY utterance_id) - 1 AS n, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM utterances_v) WHERE t <> '' GROUP BY recording_id"
    )
)
def numbered_lines(spark, d):
    return prompts.numbered_lines(view(spark, d, "utterances_v"))


@query(oracle("SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS n_edits, CASE WHEN turn % 4 < 2 THEN CAST(turn AS INTEGER) END AS first_line, CASE WHEN turn % 4 < 2 THEN concat('new [', role, ']') END AS first_text FROM conversations"))
def line_edits(spark, d):
    answer = F.expr(
        """CASE turn % 4 WHEN 0 THEN concat('Here: [{"i": ', turn, ', "text": "new [', role, ']"}] done') WHEN 1 THEN concat('[{"i": ', turn, ', "text": "new [', role, ']"}, {"i": 3, "text": "x"}]')
           WHEN 2 THEN 'nothing to fix' ELSE '[{"i": "one", "text": 4}' END"""
    )
    edits = table(spark, d, "conversations").select("conv_id", "turn", parse_line_edits(answer).alias("e"))
    return edits.select("conv_id", "turn", F.size("e").alias("n_edits"), F.get("e", F.lit(0))["line"].alias("first_line"), F.get("e", F.lit(0))["new_text"].alias("first_text"))


@query(
    oracle(
        """SELECT o_orderkey AS recording_id, concat(CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('Order ', o_orderkey, chr(10), chr(10)) END, 'Action items:', chr(10), '- ', lower(o_orderpriority), chr(10), '- ', o_orderstatus,
           CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE concat(chr(10), chr(10), 'Topics: ', o_orderstatus, ', b') END) AS block FROM orders"""
    )
)
def translation_blocks(spark, d):
    none = F.array().cast("array<string>")
    title = F.expr("CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE concat(' Order ', o_orderkey) END")
    topics = F.when(F.col("o_orderkey") % 2 == 0, none).otherwise(F.array("o_orderstatus", F.lit(" "), F.lit("b ")))
    block = prompts.translation_block(title, F.lit(None).cast("string"), F.array(F.lower("o_orderpriority"), F.lit(""), F.col("o_orderstatus")), none, topics)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("recording_id"), block.alias("block"))


@query(oracle("SELECT o_orderkey AS id, o_orderkey % 4 < 2 AS known, CASE o_orderkey % 4 WHEN 0 THEN 'standup' WHEN 1 THEN 'one_on_one' ELSE 'general' END AS template FROM orders"))
def template_resolution(spark, d):
    name = F.expr("CASE o_orderkey % 4 WHEN 0 THEN ' StandUp ' WHEN 1 THEN 'ONE_ON_ONE' WHEN 2 THEN 'retro' END")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), library.known_template(name).alias("known"), library.canonical_template(name).alias("template"))


def _by_length(texts: list[str]) -> list[list[float]]:
    """A stand-in for a model."""
    return [[0.0, float(len(x)), 0.0] for x in texts]


@query(oracle("SELECT utterance_id, CASE WHEN utterance_id % 4 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS first, CASE WHEN utterance_id % 4 = 0 THEN 0.0::DOUBLE ELSE CAST(length(text) AS DOUBLE) END AS second FROM utterances_v"))
def embed_by_model(spark, d):
    said = view(spark, d, "utterances_v").select("utterance_id", F.when(F.col("utterance_id") % 4 == 0, " ").otherwise(F.col("text")).alias("text"))
    made = embedded(said, "utterance_id", "text", _by_length, 3)
    return made.select("utterance_id", F.col("embedding")[0].cast("double").alias("first"), F.col("embedding")[1].cast("double").alias("second"))
