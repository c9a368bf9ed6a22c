"""Queries on sources, streams, settings and single rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import joins, library, prompts, queue, rows, search, speakers, windows
from ..sources import audio, schemas
from ..streaming import live
from .fixtures import oracle, table, view
from .folders import shared_folder
from .queries import NOW, _now, query


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    # a pattern, as a stream's path itself must be a folder and a table here may be one file
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


def _drained(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    out = shared_folder(spark, name)
    live.to_table(stream, f"{out}/rows", f"{out}/state").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


# --- streams --------------------------------------------------------------------------------------------------------

_SEGMENT_WORD = "CAST(floor(value) AS BIGINT) % 700"


@query(
    oracle(
        f"""SELECT CAST(floor(event_id / 200.0) AS BIGINT) AS recording_id, CAST(event_id % 200 AS INTEGER) AS seq, 0 AS ord, event_type AS w,
            CAST(coalesce(sum(dur) OVER (PARTITION BY floor(event_id / 200.0) ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + {_SEGMENT_WORD} AS BIGINT) AS start_ms,
            CAST(coalesce(sum(dur) OVER (PARTITION BY floor(event_id / 200.0) ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + {_SEGMENT_WORD} + 100 AS BIGINT) AS end_ms
            FROM (SELECT *, 1000 + (event_id % 7) * 100 AS dur FROM events WHERE floor(event_id / 200.0) IN (SELECT recording_id FROM recordings_v WHERE status = 'uploading'))"""
    )
)
def live_drain(spark, d):
    word = F.struct(F.col("event_type").alias("w"), F.expr(_SEGMENT_WORD).alias("start_ms"), F.expr(f"{_SEGMENT_WORD} + 100").alias("end_ms"))
    arriving = _stream(spark, d, "events").select(
        F.floor(F.col("event_id") / 200).alias("recording_id"), (F.col("event_id") % 200).cast("int").alias("seq"), (1000 + F.col("event_id") % 7 * 100).alias("duration_ms"), F.array(word).alias("words")
    )
    return _drained(spark, live.live_drain(arriving, view(spark, d, "recordings_v")), "live")


@query(oracle("SELECT l_orderkey AS recording_id, l_linenumber AS seq, l_shipdate AS uploaded_at, l_partkey AS part, l_suppkey AS supp, l_extendedprice AS price FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1"))
def segments_upsert_stream(spark, d):
    arriving = _stream(spark, d, "lineitem").select(F.col("l_orderkey").alias("recording_id"), F.col("l_linenumber").alias("seq"), F.col("l_shipdate").alias("uploaded_at"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_extendedprice").alias("price"))
    out = shared_folder(spark, "segments")
    live.upsert_stream(arriving, f"{out}/rows", f"{out}/state", ["recording_id", "seq"], ["uploaded_at", "part", "supp", "price"]).awaitTermination()
    return spark.read.schema(arriving.schema).parquet(f"{out}/rows").drop("bucket")


_FLIP = "floor(event_id / 200.0) % 3 = 0"
_PLACED = "SELECT *, CAST(floor(event_id / 200.0) AS BIGINT) AS r, CAST(event_id % 200 AS INTEGER) AS seq, 1000 + (event_id % 7) * 100 AS dur FROM events"
_LAID = f"""CAST(coalesce(sum(dur) OVER (PARTITION BY r ORDER BY {{order}} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + {_SEGMENT_WORD} AS BIGINT) AS start_ms"""


@query(
    oracle(
        f"""SELECT r AS recording_id, seq, 0 AS ord, event_type AS w, start_ms, start_ms + 100 AS end_ms, pass, superseded FROM (
              SELECT *, {_LAID.format(order="ts, seq")}, 'provisional' AS pass, {_FLIP} AS superseded FROM (SELECT p.* FROM placed p LEFT JOIN flips f USING (r) WHERE f.at IS NULL OR p.ts < f.at)
              UNION ALL SELECT *, {_LAID.format(order="seq")}, 'full' AS pass, FALSE FROM placed WHERE {_FLIP})""",
        placed=_PLACED,
        flips=f"SELECT r, ts AS at FROM placed WHERE seq = 120 AND {_FLIP}",
    )
)
def status_flips(spark, d):
    def segments(rows):
        word = F.struct(F.col("event_type").alias("w"), F.expr(_SEGMENT_WORD).alias("start_ms"), F.expr(f"{_SEGMENT_WORD} + 100").alias("end_ms"))
        return rows.select(F.floor(F.col("event_id") / 200).alias("recording_id"), (F.col("event_id") % 200).cast("int").alias("seq"), (1000 + F.col("event_id") % 7 * 100).alias("duration_ms"), F.array(word).alias("words"), F.col("ts").alias("at"))

    def flips(rows):
        return rows.where(f"event_id % 200 = 120 AND {_FLIP}").select(F.floor(F.col("event_id") / 200).alias("recording_id"), F.lit("processing").alias("status"), F.col("ts").alias("at"))

    provisional = _drained(spark, live.transcript_flips(segments(_stream(spark, d, "events")), flips(_stream(spark, d, "events"))), "flips")
    stored = table(spark, d, "events")
    flipped = flips(stored).select("recording_id", F.lit(True).alias("superseded"))
    provisional = provisional.join(flipped, "recording_id", "left").withColumn("superseded", F.coalesce("superseded", F.lit(False)))
    full = live.full_pass(segments(stored)).join(flipped, "recording_id", "left_semi")
    return provisional.withColumn("pass", F.lit("provisional")).unionByName(full.withColumns({"superseded": F.lit(False), "pass": F.lit("full")}))


LEASE_S = 6 * 3600


@query(
    oracle(
        f"""SELECT * FROM (
              SELECT job_id, worker, CASE WHEN before IS NULL OR epoch(t) - epoch(before) > {LEASE_S} THEN 'held' ELSE 'moved' END AS state FROM beat WHERE before IS NULL OR epoch(t) - epoch(before) > {LEASE_S} OR worker <> holder
              UNION ALL SELECT job_id, holder, 'lost' FROM beat WHERE epoch(t) - epoch(before) > {LEASE_S}
              UNION ALL SELECT job_id, worker, 'lost' FROM beat WHERE after IS NULL AND epoch(t) + {LEASE_S} < (SELECT max(epoch(t)) FROM beat))""",
        beat="SELECT *, lag(t) OVER w AS before, lag(worker) OVER w AS holder, lead(t) OVER w AS after FROM (SELECT user_id % 50 AS job_id, CAST(user_id % 3 AS VARCHAR) AS worker, ts AS t FROM events) WINDOW w AS (PARTITION BY job_id ORDER BY t, worker)",
    )
)
def lease_stream(spark, d):
    beats = _stream(spark, d, "events").select((F.col("user_id") % 50).alias("job_id"), (F.col("user_id") % 3).cast("string").alias("worker"), F.col("ts").cast("timestamp").alias("at"))
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.ROCKS)
    try:
        return _drained(spark, live.lease_state(beats, LEASE_S), "leases")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)


# --- sources --------------------------------------------------------------------------------------------------------


@query(
    oracle(
        "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'mp3' WHEN 1 THEN 'wav' WHEN 2 THEN 'flac' WHEN 3 THEN 'ogg' ELSE 'm4a' END AS ext, CASE page_id % 5 WHEN 0 THEN 'audio/mpeg' WHEN 1 THEN 'audio/wav' WHEN 2 THEN 'audio/flac' WHEN 3 THEN 'audio/ogg' ELSE 'audio/mp4' END AS media FROM pages"
    )
)
def extension_resolution(spark, d):
    asked = F.expr("CASE page_id % 5 WHEN 0 THEN '.MP3' WHEN 2 THEN '  ' END")
    kind = F.expr("CASE page_id % 5 WHEN 0 THEN 'audio/wav' WHEN 1 THEN 'Audio/X-WAV; rate=8' WHEN 2 THEN 'audio/flac' WHEN 3 THEN 'audio/opus' WHEN 4 THEN 'text/plain' END")
    return table(spark, d, "pages").select("page_id", audio.extension(asked, kind).alias("ext")).withColumn("media", audio.media_type(F.col("ext")))


@query(oracle("SELECT event_id AS path, 8000 + 1000 * (event_id % 5) AS sample_rate, event_id % 90 AS n_samples, (event_id % 90) * 1000 // (8000 + 1000 * (event_id % 5)) AS duration_ms FROM events"))
def wav_headers(spark, d):
    # a mono file of 8 bits: header and as many bytes as its event has samples
    le = lambda c, n: F.unhex(F.concat(*[F.lpad(F.hex(F.expr(f"CAST({c} AS BIGINT) >> {8 * i} & 255")), 2, "0") for i in range(n)]))
    text = lambda s: F.lit(s).cast("binary")
    rate, n = "8000 + 1000 * (event_id % 5)", "event_id % 90"
    data = F.expr(f"CAST(repeat('a', CAST({n} AS INT)) AS BINARY)")
    content = F.concat(text("RIFF"), le("0", 4), text("WAVEfmt "), le("16", 4), le("1", 2), le("1", 2), le(rate, 4), le(rate, 4), le("1", 2), le("8", 2), text("data"), le(n, 4), data)
    files = table(spark, d, "events").select(F.col("event_id").cast("string").alias("path"), content.alias("content"))
    return audio.wav_info(files).select(F.col("path").cast("long").alias("path"), "sample_rate", "n_samples", "duration_ms")


@query(oracle("SELECT user_id AS key, max(event_id) AS last_id, CAST(arg_max(json_extract(props, '$.k'), event_id) AS BIGINT) AS k FROM events GROUP BY user_id"))
def settings_documents(spark, d):
    newest = rows.latest(table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("last_id"), F.col("props").alias("value")), ["key"], ["last_id"])
    return schemas.documents(newest, "value", "struct<k:bigint>", '{"k": -1}').select("key", "last_id", "value.k")


# --- rows -----------------------------------------------------------------------------------------------------------


@query(oracle("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN upper(n_name) ELSE n_name END AS name, 'kept' AS origin FROM nation UNION ALL SELECT 100 + r_regionkey, r_name, 'new' FROM region"))
def upsert_rows(spark, d):
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("kept").alias("origin"))
    changes = nations.where("id % 2 = 0").select("id", F.upper("name").alias("name"), F.lit("new").alias("origin"))
    changes = changes.unionByName(table(spark, d, "region").select((100 + F.col("r_regionkey")).alias("id"), F.col("r_name").alias("name"), F.lit("new").alias("origin")))
    return rows.upsert(nations, changes, ["id"], ["name"], _now())


@query(oracle(f"SELECT job_id, CASE WHEN job_id IN (1, 2, 3) THEN 'done' ELSE state END AS state, CASE WHEN job_id IN (1, 2, 3) THEN NULL WHEN job_id = h AND state = 'running' THEN TIMESTAMP '{NOW}' ELSE locked_at END AS locked_at FROM jobs_v, (SELECT min(job_id) AS h FROM jobs_v WHERE state = 'running' AND job_id > 3)"))
def queue_heartbeat_complete(spark, d):
    jobs = queue.as_jobs(view(spark, d, "jobs_v")).withColumn("locked_by", F.when(F.col("state") == "running", "w1"))
    head = jobs.where("state = 'running' AND job_id > 3").agg(F.min("job_id")).first()[0]
    return queue.complete(queue.heartbeat(jobs, head, "w1", _now()), [1, 2, 3]).select("job_id", "state", "locked_at")


@query(oracle("SELECT recording_id, template, title FROM (SELECT o_custkey AS recording_id, CASE WHEN o_orderkey % 3 = 0 THEN 'general' ELSE lower(o_orderpriority) END AS template, 'Order ' || o_orderkey AS title, o_orderdate, o_orderkey FROM orders) QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY template <> 'general', o_orderdate, template, title) = 1"))
def summary_pick(spark, d):
    summaries = table(spark, d, "orders").select(
        F.col("o_custkey").alias("recording_id"), F.expr("CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'general' END ELSE lower(o_orderpriority) END").alias("template"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"), F.lit("").alias("summary"), F.col("o_orderdate").alias("created_at")
    )
    # a template that was never set is the general one
    return library.chosen_summary(summaries.withColumn("template", F.coalesce("template", F.lit("general")))).select("recording_id", "template", "title")


@query(oracle("SELECT s_suppkey AS speaker_id, lower(s_name) = 'supplier#000000007' AS same FROM supplier"))
def same_name(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("speaker_id"), X.same_name(F.col("s_name"), F.lit("SUPPLIER#000000007")).alias("same"))


@query(oracle("SELECT r.recording_id, r.local_idx, CASE WHEN r.recording_id = f.recording_id AND r.local_idx = f.local_idx THEN 7 ELSE r.speaker_id END AS speaker_id FROM recording_speakers_v r, (SELECT recording_id, local_idx FROM recording_speakers_v ORDER BY recording_id, local_idx LIMIT 1) f"))
def name_speaker(spark, d):
    voices = view(spark, d, "recording_speakers_v").withColumn("embedding", F.lit(None).cast("array<float>"))
    first = voices.orderBy("recording_id", "local_idx").first()
    return rows.name_speaker(view(spark, d, "speakers_v"), voices, first["recording_id"], first["local_idx"], name="supplier#000000007")[1].select("recording_id", "local_idx", "speaker_id")


# --- texts and time -------------------------------------------------------------------------------------------------


# every fifth token is written otherwise than its word, so it takes the time between its neighbours
@query(
    oracle(
        """SELECT utterance_id, CAST(pos AS INTEGER) AS pos, CASE WHEN word_ord % 5 = 2 THEN 'other' ELSE concat(upper(w), word_ord, ',') END AS token,
                  CASE WHEN word_ord % 5 = 2 AND pos > 0 THEN before ELSE CASE WHEN word_ord % 5 = 2 THEN first ELSE start_ms END END AS start_ms,
                  CASE WHEN word_ord % 5 = 2 THEN coalesce(after, greatest(before, last)) ELSE end_ms END AS end_ms
           FROM (SELECT concat_ws('-', recording_id, utterance_no) AS utterance_id, *, row_number() OVER w - 1 AS pos, lag(end_ms) OVER w AS before, lead(start_ms) OVER w AS after, min(start_ms) OVER (PARTITION BY recording_id, utterance_no) AS first,
                 max(end_ms) OVER (PARTITION BY recording_id, utterance_no) AS last FROM long_words_v WINDOW w AS (PARTITION BY recording_id, utterance_no ORDER BY word_ord))"""
    )
)
def timed_tokens(spark, d):
    shown = F.when(F.col("word_ord") % 5 == 2, "other").otherwise(F.concat(F.upper("w"), "word_ord", F.lit(",")))
    own = view(spark, d, "long_words_v").withColumn("shown", shown).withColumn("w", F.concat("w", "word_ord"))
    said = own.groupBy(F.concat_ws("-", "recording_id", "utterance_no").alias("utterance_id")).agg(
        windows.joined("word_ord", "shown").alias("text"), F.sort_array(F.collect_list(F.struct("start_ms", "end_ms", "w"))).alias("words"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")
    )
    return prompts.timed_tokens(said).select("utterance_id", F.posexplode("tokens").alias("pos", "t")).select("utterance_id", "pos", "t.token", "t.start_ms", "t.end_ms")


@query(
    oracle(
        """SELECT recording_id, word_no, string_agg(w, '' ORDER BY word_ord) AS w, arg_min(start_ms, word_ord) AS start_ms, max(end_ms) AS end_ms FROM
           (SELECT *, CAST(sum(CASE WHEN word_ord % 3 = 0 OR word_ord = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY word_ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS word_no FROM words_v) GROUP BY recording_id, word_no"""
    )
)
def words_of_tokens(spark, d):
    tokens = view(spark, d, "words_v").withColumn("token", F.when(F.col("word_ord") % 3 == 0, F.concat(F.lit(" "), F.col("w"))).otherwise(F.col("w")))
    return windows.words_of_tokens(tokens, ["recording_id"], "word_ord")


@query(oracle("SELECT n_regionkey AS recording_id, concat('# Region', chr(10), chr(10), '## Nations', chr(10), string_agg('- ' || n_name, chr(10) ORDER BY n_name)) AS outline FROM nation GROUP BY n_regionkey"))
def mind_map(spark, d):
    names = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("recording_id")).agg(F.sort_array(F.collect_list("n_name")).alias("items"))
    none = F.array().cast("array<string>")
    branches = F.array(F.struct(F.lit("Nations").alias("name"), F.col("items").alias("items")), F.struct(F.lit("Empty").alias("name"), none.alias("items")))
    return names.select("recording_id", prompts.outline(F.lit("Region"), branches).alias("outline"))


@query(
    oracle(
        """SELECT recording_id, word_ord, ['alpha', 'bravo', 'charlie', 'delta', 'echo'][word_ord % 5 + 1] AS w, dur * word_ord // n AS start_ms, dur * (word_ord + 1) // n AS end_ms, CAST(dur * word_ord // n // 10000 % 2 AS INTEGER) AS local_idx
           FROM (SELECT *, unnest(range(n)) AS word_ord FROM (SELECT l_orderkey AS recording_id, CAST(sum(floor(l_quantity)) AS BIGINT) * 1000 AS dur, least(greatest(CAST(sum(floor(l_quantity)) AS BIGINT) * 4000 // 5000, 3), 64) AS n FROM lineitem GROUP BY l_orderkey))"""
    )
)
def stub_speech(spark, d):
    lengths = view(spark, d, "segments_v").groupBy("recording_id").agg(F.sum("duration_ms").alias("duration_ms"))
    return speakers.stub_speech(lengths)


@query(oracle("SELECT recording_id, word_ord, local_idx FROM (SELECT w.recording_id, w.word_ord, t.local_idx, row_number() OVER (PARTITION BY w.recording_id, w.word_ord ORDER BY abs((w.start_ms + w.end_ms) // 2 - (t.start_ms + t.end_ms) // 2), t.turn_ord) AS k FROM words_v w JOIN turns_v t USING (recording_id)) WHERE k = 1"))
def nearest_in_time(spark, d):
    return joins.nearest_turn(view(spark, d, "words_v"), view(spark, d, "turns_v"))


@query(oracle("SELECT c.chunk_id, r.title FROM chunks_v c JOIN recordings_v r USING (recording_id) WHERE r.created_at >= TIMESTAMP '2001-08-01' - INTERVAL 7 DAY OR c.recording_id = 12"))
def search_scope_week(spark, d):
    views = [view(spark, d, f"{n}_v") for n in ("chunks", "recordings", "recording_speakers")]
    week = search.scoped(*views, search.Filters(since="2001-07-25")).chunks
    found = week.unionByName(search.scoped(*views, search.Filters(recording_id=12, until="2001-07-24")).chunks)
    return found.select("chunk_id", "recording_id").join(views[1].select("recording_id", "title"), "recording_id").select("chunk_id", "title")


@query(oracle("SELECT label, median(ms) AS median_ms FROM (SELECT label, 400 + (vec_id % 40) * 100 AS ms FROM embeddings) GROUP BY label"))
def median_turns(spark, d):
    return table(spark, d, "embeddings").select("label", (400 + F.col("vec_id") % 40 * 100).alias("ms")).groupBy("label").agg(F.median("ms").alias("median_ms"))


@query(oracle("SELECT recording_id, count(DISTINCT local_idx) AS n_speakers, max(local_idx) + 1 AS n_clusters FROM recording_speakers_v GROUP BY recording_id"))
def speaker_counts(spark, d):
    return view(spark, d, "recording_speakers_v").groupBy("recording_id").agg(F.countDistinct("local_idx").alias("n_speakers"), (F.max("local_idx") + 1).alias("n_clusters"))


@query(oracle("SELECT recording_id, kind, job_id, state FROM jobs_v QUALIFY row_number() OVER (PARTITION BY recording_id, kind ORDER BY job_id DESC) = 1"))
def latest_jobs(spark, d):
    return rows.latest(view(spark, d, "jobs_v").select("recording_id", "kind", "job_id", "state"), ["recording_id", "kind"], ["job_id"])


@query(oracle("SELECT utterance_id, CAST(i AS INTEGER) AS pos, t[i + 1] AS w, CAST(i * (span // n) AS BIGINT) AS start_ms, CAST(CASE WHEN i = n - 1 THEN span ELSE (i + 1) * (span // n) END AS BIGINT) AS end_ms FROM (SELECT *, unnest(range(n)) AS i FROM toks)", toks=r"SELECT utterance_id, end_ms - start_ms AS span, t, len(t) AS n FROM (SELECT *, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS t FROM utterances_v)"))
def spread_words(spark, d):
    spread = view(spark, d, "utterances_v").select("utterance_id", F.posexplode(windows.spread_evenly(F.col("text"), F.col("end_ms") - F.col("start_ms"))).alias("pos", "x"))
    return spread.select("utterance_id", "pos", "x.w", F.col("x.start_ms").cast("long").alias("start_ms"), F.col("x.end_ms").cast("long").alias("end_ms"))


@query(oracle("SELECT DISTINCT recording_id FROM jobs_v WHERE kind = 'merge' AND state = 'done'"))
def recordings_to_reindex(spark, d):
    return queue.stages_done(view(spark, d, "jobs_v"), ("merge",))


@query(oracle("SELECT now_at, greatest(coalesce(s, 3600), 60) AS delay FROM (SELECT o_orderkey AS now_at, CASE o_orderkey % 3 WHEN 0 THEN 5 WHEN 1 THEN 500 END AS s FROM orders)"))
def retry_delays(spark, d):
    from ..operators.schedule import retry_delay

    return table(spark, d, "orders").select(F.col("o_orderkey").alias("now_at"), retry_delay(F.expr("CASE o_orderkey % 3 WHEN 0 THEN 5 WHEN 1 THEN 500 END")).alias("delay"))


@query(oracle("SELECT day, enabled, start_min, end_min FROM schedule_v WHERE day < 5 UNION ALL SELECT 5, FALSE, 540, 1020 UNION ALL SELECT 6, FALSE, 540, 1020"))
def schedule_normalized(spark, d):
    from ..operators.schedule import normalised

    return normalised(view(spark, d, "schedule_v").where("day < 5").unionByName(spark.createDataFrame([(9, True, 0, 9000)], "day int, enabled boolean, start_min int, end_min int")))


@query(oracle("SELECT recording_id, first_turn, n_turns FROM (SELECT conv_id AS recording_id, min(turn) AS first_turn, count(*) AS n_turns FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2) GROUP BY conv_id)"))
def last_turns(spark, d):
    last = windows.last_n(table(spark, d, "conversations"), ["conv_id"], "turn", 2)
    return last.groupBy(F.col("conv_id").alias("recording_id")).agg(F.min("turn").alias("first_turn"), F.count("*").alias("n_turns"))
