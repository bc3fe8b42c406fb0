"""Names, tags and search text: column expressions, and one Arrow function for Unicode decomposition."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setloom.functions.camelot import key_text

# Fixed values.
AUDIO_EXTENSIONS = ["mp3", "wav", "flac", "aiff", "aif", "m4a", "aac", "ogg", "opus"]
BPM_LOW, BPM_HIGH, SAME_TEMPO = 60, 200, 0.04
TEMPO_FAMILIES = [1.0, 2.0, 0.5, 1.5, 2.0 / 3.0]
TRACK_URI = "spotify:track:"
#: Forms of a tempo in a name, the surest first: how it is called, its pattern, its confidence; and a form that callers may allow.
TEMPO_FORMS = [("bpm-suffix", r"(?i)(?<![\d.])(\d{2,3})\s*bpm\b", 1.0), ("bracket", r"[\[(](\d{2,3})[\])]\s*$", 0.95), ("trailing", r"\s(\d{2,3})\s*$", 0.9)]
LEADING_FORM = ("leading", r"^(\d{2,3})\s*[-_.\s]", 0.5)
#: What a file name can't hold, and the order in which doubled separators, empty brackets and stray spaces go.
UNSAFE = r'[/\\:*?"<>|]'
COLLAPSES = [(r"\s*[-_·]\s*[-_·]", " -"), (r"\[\s*\]", ""), (r"\(\s*\)", ""), (r"\s{2,}", " "), (r"\s+([)\]}])", "$1"), (r"([(\[{])\s+", "$1")]
EMPTY_NAME = "template rendered empty (missing tags?)"
TRACK_LINK, TRACK_ID = r"open\.spotify\.com/(?:intl-\w+/)?track/([a-zA-Z0-9]+)", "^[a-zA-Z0-9]{22}$"


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(name: Column) -> Column:
    """With its dot; a dot in front of everything is no extension."""
    return F.regexp_extract(name, r"^.+?((?:\.[^.]*)?)$", 1)


def is_audio(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin(AUDIO_EXTENSIONS)


def is_hidden(path: Column) -> Column:
    return F.coalesce(path, F.lit("")).rlike(r"(^|/)\.[^/]")


def matches(needle: str, *columns: Column) -> Column:
    """Literal case-insensitive containment in any column; a blank needle matches all."""
    wanted = needle.strip().lower()
    if not wanted:
        return F.lit(True)
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.contains(F.lower(c), F.lit(wanted)), F.lit(False))
    return out


def in_range(bpm: Column) -> Column:
    return bpm.between(BPM_LOW, BPM_HIGH)


def bpm_from_name(name: Column, allow_leading: bool = False) -> Column:
    """struct(bpm, source, confidence) read from a file name, or null; a value out of range falls to the next form."""
    base = F.trim(F.regexp_replace(basename(name), r"^(.+)\.[^.]*$", "$1"))
    found = []
    for source, pattern, confidence in TEMPO_FORMS + [LEADING_FORM] * allow_leading:
        value = F.regexp_extract(base, pattern, 1).try_cast("int")
        found.append(F.when(in_range(value), F.struct(value.alias("bpm"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence"))))
    return F.coalesce(*found)


def near(x: Column, target: float) -> Column:
    return F.abs(x - target) <= SAME_TEMPO * target


def reconciled(named: Column, bpm: Column, confidence: Column) -> Column:
    """struct(bpm, confidence, source): the name wins; agreement up to a tempo family keeps its confidence."""
    ratio = bpm / named["bpm"]
    agrees = F.lit(False)
    for t in TEMPO_FAMILIES:
        agrees = agrees | near(ratio, t)
    sure = F.when(agrees, F.greatest(named["confidence"], confidence)).otherwise(named["confidence"] * 0.7)
    return F.when(named.isNull(), F.struct(bpm.alias("bpm"), confidence.alias("confidence"), F.lit("audio").alias("source"))).otherwise(
        F.struct(named["bpm"].cast("double").alias("bpm"), sure.alias("confidence"), F.lit("name").alias("source"))
    )


@F.pandas_udf(T.StringType())
def strip_marks(texts: pd.Series) -> pd.Series:
    """Canonical decomposition without the marks U+0300 to U+036F."""
    drop = dict.fromkeys(range(0x300, 0x370))
    return texts.map(lambda t: None if t is None else t if t.isascii() else unicodedata.normalize("NFD", t).translate(drop))


def match_text(text: Column) -> Column:
    """Lower case, no marks, no bracketed parts, runs of anything but a-z and 0-9 as one space, trimmed."""
    plain = F.regexp_replace(strip_marks(F.lower(text)), r"\(.*?\)|\[.*?\]", "")
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def duplicate_key(title: Column, artist: Column) -> Column:
    """artist|title in match form; empty if the title is."""
    t = match_text(F.coalesce(title, F.lit("")))
    return F.when(t == "", "").otherwise(F.concat(match_text(F.coalesce(artist, F.lit(""))), F.lit("|"), t))


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, " "), lambda w: w != ""))


def overlap(a: Column, b: Column) -> Column:
    """Words in common over the larger word count; 0 with an empty side."""
    x, y = words(a), words(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y))).otherwise(0.0)


def search_text(text: Column) -> Column:
    """Without bracketed parts, what follows a dash, and featured artists."""
    out = F.regexp_replace(text, r"\(.*?\)|\[.*?\]", "")
    out = F.regexp_replace(out, r"\s+-\s+.*", "")
    return F.trim(F.regexp_replace(out, r"(?i)\s+feat\..*", ""))


def search_query(title: Column, artist: Column) -> Column:
    return F.concat(F.lit("track:"), search_text(title), F.lit(" artist:"), search_text(artist))


def match_score(title: Column, artist: Column, seconds: Column, hit_title: Column, hit_artists: Column, hit_seconds: Column) -> Column:
    """0.6 title + 0.3 best artist + 0.1 duration (10 s to nothing; 0.5 without a wanted duration)."""
    best_artist = F.array_max(F.concat(F.array(F.lit(0.0)), F.transform(hit_artists, lambda a: overlap(artist, a))))
    close = F.when(seconds > 0, F.greatest(F.lit(0.0), 1 - F.abs(hit_seconds - seconds) / 10)).otherwise(0.5)
    return 0.6 * overlap(title, hit_title) + 0.3 * best_artist + 0.1 * close


def sanitized(text: Column) -> Column:
    safe = F.regexp_replace(F.coalesce(text, F.lit("")), UNSAFE, "_")
    return F.trim(F.regexp_replace(safe, r"\s+", " "))


def collapsed(text: Column) -> Column:
    """Doubled separators, empty brackets and stray spaces, in this order."""
    for pattern, into in COLLAPSES:
        text = F.regexp_replace(text, pattern, into)
    return F.trim(text)


def rendered(template: str, fields: dict[str, Column]) -> Column:
    """A file-name template with {artist} {title} {album} {genre} {bpm} {key} {camelot} {year}, any case."""
    out, at = [], 0
    for m in re.finditer(r"\{(artist|title|album|genre|bpm|key|camelot|year)\}", template, re.I):
        out += [F.lit(template[at : m.start()]), _field(m[1].lower(), fields)]
        at = m.end()
    return F.concat(*out, F.lit(template[at:]))


def _field(name: str, fields: dict[str, Column]) -> Column:
    empty = F.lit("")
    if name == "year" or name not in fields and name != "key":
        return empty
    if name == "bpm":
        return F.coalesce(F.floor(fields["bpm"] + 0.5).cast("string"), empty)
    if name == "key":
        return key_text(fields["camelot"]) if "camelot" in fields else empty
    if name == "camelot":
        return F.coalesce(fields["camelot"], empty)
    return sanitized(fields[name])


def new_name(path: Column, rendered_name: Column) -> Column:
    """The cleaned name with the old extension; the old name if nothing is left."""
    old, clean = basename(path), collapsed(F.trim(rendered_name))
    return F.when(clean != "", F.concat(clean, extension(old))).otherwise(old)


def rename_preview(path: Column, rendered_name: Column) -> Column:
    """struct(new_name, changed, reason): reason says why a name stays although a template was rendered."""
    name, empty = new_name(path, rendered_name), collapsed(F.trim(rendered_name)) == ""
    return F.struct(name.alias("new_name"), (name != basename(path)).alias("changed"), F.when(empty, EMPTY_NAME).alias("reason"))


def track_uri(text: Column) -> Column:
    """A catalog track address in canonical form, from the form itself, a link or a bare id; else null."""
    link = F.regexp_extract(text, TRACK_LINK, 1)
    return F.when(text.startswith(TRACK_URI), text).when(link != "", F.concat(F.lit(TRACK_URI), link)).when(text.rlike(TRACK_ID), F.concat(F.lit(TRACK_URI), text))


def minutes(seconds: Column) -> Column:
    """m:ss"""
    s = F.floor(F.coalesce(seconds, F.lit(0.0))).cast("long")
    return F.format_string("%d:%02d", F.floor(s / 60).cast("long"), s % 60)


def countdown(seconds: Column) -> Column:
    """m:ss from a minute on, else whole seconds, begun ones counted."""
    return F.when(seconds >= 60, minutes(seconds)).otherwise(F.concat(F.ceil(seconds).cast("string"), F.lit("s")))


def age(then_ms: Column, now_ms: Column) -> Column:
    s = F.floor((now_ms - then_ms) / 1000).cast("long")
    unit = lambda n, u: F.concat(F.floor(s / n).cast("string"), F.lit(u))
    return F.when(s < 60, unit(1, "s")).when(s < 3600, unit(60, "m")).when(s < 86400, unit(3600, "h")).otherwise(unit(86400, "d"))


def short_path(path: Column) -> Column:
    return F.array_join(F.slice(F.split(path, "/"), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(1)), 2), "/")


def file_url_path(url: Column) -> Column:
    """The path of a file:// address, decoded; a plus sign stays one."""
    rest = F.regexp_replace(url, r"^file://(localhost)?", "")
    return F.when(url.startswith("file://"), F.try_url_decode(F.replace(rest, F.lit("+"), F.lit("%2B"))))
