"""Text columns: tokens, fillers, titles, edits, clocks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hesitation sounds dropped from transcripts by default.
FILLERS = ("uh", "uhh", "um", "umm", "uhm", "er", "err", "erm", "ah", "ahh", "hmm", "hm", "mm", "mmm", "mhm", "eh", "uhhuh")


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends (``trim`` takes spaces only)."""
    return F.regexp_replace(text, "^[\\s\\p{Z}]+|[\\s\\p{Z}]+$", "")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def same_name(a: Column, b: Column) -> Column:
    """Equal but for ASCII case."""
    return ascii_lower(a) == ascii_lower(b)


def contains_ignoring_case(text: Column, part: str) -> Column:
    return F.contains(F.lower(text), F.lit(part.lower()))


def words(text: Column) -> Column:
    """Runs of anything but white space; blank text has none."""
    return F.filter(F.split(text, "\\s+"), lambda x: x != "")


def lexemes(text: Column) -> Column:
    """The simple analyzer: lower case, cut at all but letters and digits."""
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda x: x != "")


def bare_word(word: Column) -> Column:
    """Lower case, without what is not a letter or digit at both ends; inner characters stay."""
    return ascii_lower(F.regexp_replace(word, "^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$", ""))


def is_filler(word: Column, fillers: Iterable[str] = FILLERS) -> Column:
    return bare_word(word).isin([f.lower() for f in fillers])


def without_fillers(items: Column, fillers: Iterable[str] = FILLERS) -> Column:
    """An array of words without the fillers."""
    return F.filter(items, lambda w: ~is_filler(w, fillers))


def compare_key(token: Column) -> Column:
    """Lower case with a-z, 0-9 and apostrophes only, or the lower-case token if nothing is left."""
    low = F.lower(token)
    return F.coalesce(F.nullif(F.regexp_replace(low, "[^a-z0-9']", ""), F.lit("")), low)


def slug(title: Column) -> Column:
    """A file name's base: a-z, 0-9 and single hyphens, 60 characters, ``recording`` if empty."""
    cut = F.left(F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-|-$", ""), F.lit(60))
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("recording"))


def clean_title(text: Column, limit: int = 120) -> Column:
    """The first line that is not blank, without quotes around it; null if there is none."""
    lines = F.filter(F.transform(F.split(text, "\n"), trimmed), lambda x: x != "")
    bare = trimmed(F.regexp_replace(F.get(lines, F.lit(0)), "^[\"'`]+|[\"'`]+$", ""))
    return F.nullif(F.left(bare, F.lit(limit)), F.lit(""))


def shortened(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, an ellipsis after a cut."""
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("…"))).otherwise(text)


def _far(old: Column, new: Column) -> Column:
    return F.abs(F.length(new) - F.length(old)) > F.greatest(F.floor(F.length(old) / 3), F.lit(12))


def accepts_edit(old: Column, new: Column) -> Column:
    """A correction counts if it is not blank, changes something, and changes the length little; white space around it is not counted."""
    own = trimmed(new)
    return (own != "") & (own != old) & ~_far(old, own)


def accepts_padded_edit(old: Column, new: Column) -> Column:
    """As :func:`accepts_edit` for texts that keep their padding: spaces around either change nothing, but count as length."""
    return (F.trim(new) != "") & (F.trim(new) != F.trim(old)) & ~_far(old, new)


def marked_parts(text: Column, part: Column) -> Column:
    """``text`` cut at every place where ``part`` stands, ignoring case: array of (text, hit), empty pieces left out.

    A blank ``part`` marks nothing.  Lower case must not change the length, else the text is one piece.
    """
    low, find = F.lower(text), F.lower(trimmed(part))
    pieces = F.split(low, F.concat(F.lit("\\Q"), F.replace(find, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    width = F.length(find)
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<text:string,hit:boolean>>").alias("out"))

    def step(s: Column, piece: Column) -> Column:
        plain = F.struct(F.substring(text, s["at"], F.length(piece)).alias("text"), F.lit(False).alias("hit"))
        hit = F.struct(F.substring(text, s["at"] + F.length(piece), width).alias("text"), F.lit(True).alias("hit"))
        return F.struct((s["at"] + F.length(piece) + width).alias("at"), F.concat(s["out"], F.array(plain, hit)).alias("out"))

    parts = F.filter(F.aggregate(pieces, start, step, lambda s: s["out"]), lambda p: p["text"] != "")
    whole = F.filter(F.array(F.struct(text.alias("text"), F.lit(False).alias("hit"))), lambda p: p["text"] != "")
    return F.when((find != "") & (F.length(low) == F.length(text)), parts).otherwise(whole)


def version_at_least(version: Column, least: Column) -> Column:
    """Dotted versions compared number by number; what is missing or no number counts as 0."""
    numbers = lambda v: F.transform(F.split(v, "\\."), lambda x: F.coalesce(F.regexp_extract(x, "^[0-9]+", 0).try_cast("int"), F.lit(0)))
    a, b = numbers(version), numbers(least)
    n = F.greatest(F.size(a), F.size(b))
    padded = lambda x: F.concat(x, F.array_repeat(F.lit(0), n - F.size(x)))
    return padded(a) >= padded(b)


def clock(ms: Column) -> Column:
    """``m:ss``, with hours ``h:mm:ss``."""
    s = F.floor(F.greatest(ms, F.lit(0)) / 1000)
    h, m, rest = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, rest)).otherwise(F.format_string("%d:%02d", m, rest))


def minutes_clock(ms: Column) -> Column:
    """``mm:ss``; minutes may exceed 59."""
    s = F.floor(F.greatest(ms, F.lit(0)) / 1000)
    return F.format_string("%02d:%02d", F.floor(s / 60), s % 60)


def srt_time(ms: Column) -> Column:
    """``HH:MM:SS,mmm``."""
    c = F.greatest(ms, F.lit(0)).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(c / 3_600_000), F.floor(c % 3_600_000 / 60_000), F.floor(c % 60_000 / 1000), c % 1000)


def speaker_label(name: Column, local_idx: Column, nobody: str) -> Column:
    """A name, else ``Speaker N``, else what stands for nobody."""
    return F.coalesce(name, F.concat(F.lit("Speaker "), local_idx.cast("string")), F.lit(nobody))
