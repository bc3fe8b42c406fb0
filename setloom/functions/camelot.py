"""Musical keys on the Camelot wheel, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The position of each key on the wheel, and the spellings of sharps.
WHEEL = {
    "C major": "8B", "A minor": "8A",
    "G major": "9B", "E minor": "9A",
    "D major": "10B", "B minor": "10A",
    "A major": "11B", "F# minor": "11A",
    "E major": "12B", "C# minor": "12A",
    "B major": "1B", "G# minor": "1A",
    "F# major": "2B", "D# minor": "2A",
    "C# major": "3B", "A# minor": "3A",
    "G# major": "4B", "F minor": "4A",
    "D# major": "5B", "C minor": "5A",
    "A# major": "6B", "G minor": "6A",
    "F major": "7B", "D minor": "7A",
}
FLATS = {"Db": "C#", "Eb": "D#", "Gb": "F#", "Ab": "G#", "Bb": "A#"}
PITCHES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
SHORT_KEYS = {code: key.split()[0] + ("m" if key.endswith("minor") else "") for key, code in WHEEL.items()}


def mapping(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def normalize_root(root: Column) -> Column:
    """Sharps for flats; anything else is trimmed."""
    trimmed = F.trim(root)
    return F.coalesce(F.try_element_at(mapping(FLATS), trimmed), trimmed)


def to_camelot(root: Column, scale: Column) -> Column:
    """The wheel's code; an unknown key raises an error, null stays null."""
    key = F.concat_ws(" ", root, scale)
    found = F.try_element_at(mapping(WHEEL), key)
    return F.when(root.isNull() | scale.isNull(), F.lit(None).cast("string")).otherwise(F.coalesce(found, F.raise_error(F.concat(F.lit("unknown key: "), key)).cast("string")))


def number(code: Column) -> Column:
    return F.substring(code, 1, F.length(code) - 1).try_cast("int")


def letter(code: Column) -> Column:
    return F.right(code, F.lit(1))


def compatibility(a: Column, b: Column) -> Column:
    """1 for the same code, .9 a step on the ring, .85 across the rings, .25 otherwise; null with a null side.

    The rule for a ring distance of 7 can't apply on a ring of 12 and is left out.
    """
    d = F.abs(number(a) - number(b))
    ring = F.least(d, 12 - d)
    same_letter = letter(a) == letter(b)
    return F.when(a == b, 1.0).when(same_letter & (ring == 1), 0.9).when(number(a) == number(b), 0.85).when(a.isNotNull() & b.isNotNull(), 0.25)


def key_text(code: Column) -> Column:
    """Short key name such as F#m; empty for an unknown code."""
    return F.coalesce(F.try_element_at(mapping(SHORT_KEYS), code), F.lit(""))
