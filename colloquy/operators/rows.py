"""Row changes on immutable tables: upserts, deletes with cascades, replacements, speakers' names.

Each function maps tables to the tables that replace them.  Write the result as a
new snapshot and publish it as a whole.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import same_name, trimmed

CHILDREN = ("segments", "jobs", "recording_speakers", "utterances", "chunks", "summaries", "artifacts")


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key that is largest in ``order``; one aggregation, no window."""
    rest = [c for c in rows.columns if c not in keys]
    top = rows.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_row"))
    return top.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in rows.columns])


def upsert(table: DataFrame, changes: DataFrame, keys: Sequence[str], replaced: Sequence[str], now: Column, stamp: str | None = None) -> DataFrame:
    """``changes`` replace the columns ``replaced`` of rows with their key, or are new rows.

    Other columns of a row that is there stay.  ``changes`` has each key once.
    """
    fresh = changes.select(*keys, F.struct(*[c for c in changes.columns if c not in keys]).alias("_new"), F.lit(True).alias("_is"))
    own = table.withColumn("_old", F.lit(True))
    both = own.join(fresh, list(keys), "full")
    given = set(changes.columns)

    def value(c: str) -> Column:
        if c == stamp:
            return F.when(F.col("_is"), now).otherwise(F.col(c))
        if c not in given:
            return F.col(c)
        if c in replaced:
            return F.when(F.col("_is"), F.col(f"_new.{c}")).otherwise(F.col(c))
        return F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"_new.{c}"))

    return both.select(*[F.col(c) if c in keys else value(c).alias(c) for c in table.columns])


def insert_absent(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return table.unionByName(rows.join(table.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def changed(table: DataFrame, where: Column, **values: Column) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    return table.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in values.items()})


def auto_title(recordings: DataFrame, titles: DataFrame) -> DataFrame:
    """Set titles (recording_id, new_title) where the title is automatic, null or empty."""
    rows = recordings.join(titles, "recording_id", "left")
    free = F.col("new_title").isNotNull() & (F.col("title_auto") | F.col("title").isNull() | (F.col("title") == ""))
    return changed(rows, free, title=F.col("new_title"), title_auto=F.lit(True)).drop("new_title")


def delete_recordings(tables: Mapping[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Recordings go, and with them what belongs to them; enrolled speakers stay."""
    gone = ids.select("recording_id").distinct()
    return {k: t.join(gone, "recording_id", "left_anti") if k == "recordings" or k in CHILDREN else t for k, t in tables.items()}


def reset_recordings(tables: Mapping[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """For processing anew: results and jobs go, segments stay, the status is ``processing``."""
    gone = ids.select("recording_id").distinct()
    out = {k: t.join(gone, "recording_id", "left_anti") if k in CHILDREN and k != "segments" else t for k, t in tables.items()}
    flagged = tables["recordings"].join(gone.withColumn("_hit", F.lit(True)), "recording_id", "left")
    return out | {"recordings": changed(flagged, F.col("_hit"), status=F.lit("processing")).drop("_hit")}


def replace_rows(table: DataFrame, rows: DataFrame, key: str = "recording_id") -> DataFrame:
    """All rows of the keys in ``rows`` are replaced."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def delete_speaker(speakers: DataFrame, recording_speakers: DataFrame, speaker_id) -> tuple[DataFrame, DataFrame]:
    """The speaker goes; who was named so is unnamed."""
    kind = recording_speakers.schema["speaker_id"].dataType
    return speakers.where(F.col("speaker_id") != speaker_id), changed(recording_speakers, F.col("speaker_id") == speaker_id, speaker_id=F.lit(None).cast(kind))


def merge_speakers(speakers: DataFrame, recording_speakers: DataFrame, source, target) -> tuple[DataFrame, DataFrame]:
    """What was ``source`` becomes ``target``; a speaker cannot be merged with itself."""
    if source == target:
        raise ValueError("a speaker cannot be merged with itself")
    kind = recording_speakers.schema["speaker_id"].dataType
    return speakers.where(F.col("speaker_id") != source), changed(recording_speakers, F.col("speaker_id") == source, speaker_id=F.lit(target).cast(kind))


def name_speaker(speakers: DataFrame, recording_speakers: DataFrame, recording_id, local_idx: int, name: str | None = None, speaker_id=None, new_id=None) -> tuple[DataFrame, DataFrame]:
    """Name a diarized speaker.

    An id counts before a name; a name is that of an enrolled speaker but for
    ASCII case, or a new one with ``new_id``.  The voice's vector is enrolled only
    if the speaker has none.  ``recording_speakers`` has an ``embedding``.
    """
    if speaker_id is None and not (name or "").strip():
        raise ValueError("a speaker needs an id or a name")
    own = (F.col("recording_id") == recording_id) & (F.col("local_idx") == local_idx)
    voice = recording_speakers.where(own).select("embedding").first()
    if voice is None:
        raise LookupError("no such speaker in the recording")
    if speaker_id is None:
        known = speakers.where(same_name(F.col("display_name"), F.lit(name.strip()))).orderBy("speaker_id").select("speaker_id").first()
        speaker_id = known[0] if known else new_id
        if known is None:
            speakers = speakers.unionByName(speakers.sparkSession.createDataFrame([(new_id, name.strip(), None)], speakers.select("speaker_id", "display_name", "embedding").schema), allowMissingColumns=True)
    vector = F.lit(None).cast("array<float>") if voice[0] is None else F.array(*[F.lit(float(x)) for x in voice[0]]).cast("array<float>")
    speakers = changed(speakers, (F.col("speaker_id") == speaker_id) & F.col("embedding").isNull(), embedding=vector)
    kind = recording_speakers.schema["speaker_id"].dataType
    return speakers, changed(recording_speakers, own, speaker_id=F.lit(speaker_id).cast(kind))


def unname_speaker(recording_speakers: DataFrame, recording_id, local_idx: int) -> DataFrame:
    """A diarized speaker is nobody again; enrolled speakers stay."""
    kind = recording_speakers.schema["speaker_id"].dataType
    return changed(recording_speakers, (F.col("recording_id") == recording_id) & (F.col("local_idx") == local_idx), speaker_id=F.lit(None).cast(kind))


def edit_text(utterances: DataFrame, edits: DataFrame) -> DataFrame:
    """New texts (utterance_id, new_text), trimmed; blank ones are refused."""
    rows = utterances.join(edits, "utterance_id", "left")
    return changed(rows, trimmed(F.col("new_text")) != "", text=trimmed(F.col("new_text"))).drop("new_text")


def checked_participants(n: int | None) -> int | None:
    if n is not None and not 1 <= n <= 64:
        raise ValueError("participants are 1 to 64")
    return n


def unzipped(rows: DataFrame, *arrays: str) -> DataFrame:
    """Parallel arrays as rows; arrays of different lengths raise an error."""
    same = F.lit(True)
    for other in arrays[1:]:
        same &= F.size(other) == F.size(arrays[0])
    keep = [c for c in rows.columns if c not in arrays]
    checked = F.when(same, F.arrays_zip(*arrays)).otherwise(F.raise_error(F.lit("arrays differ in length")))
    return rows.select(*keep, F.posexplode(checked).alias("ord", "_x")).select(*keep, "ord", *[F.col(f"_x.{a}").alias(a) for a in arrays])
