"""Language identification by compression with per-language dictionaries.

A text's words, lower-cased, are compressed once per language with that language's
raw-content zstandard dictionary, in chunks, so that a long text can't serve as its own
dictionary; the language with the smallest total wins. Learning takes the whole texts of a
bounded sample of labelled rows, chosen by a hash, as raw dictionary content: nothing else is trained.

Compressed sizes are whole bytes, and a chunk that does not compress is stored raw in every
language. So where the sizes are too few bytes to show the margin and tie, code lengths in
fractions of a bit, from the letter sequences of the same dictionaries, decide instead.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setloom.llm.common import arrow_rows

#: Bound of the training sample: rows a language, whose whole texts are its dictionary, and languages.
SAMPLE_ROWS, MOST_LANGUAGES = 80, 1000
LEVEL, CHUNK_BYTES = 3, 512
#: A text is rejected if the runner-up needs less than this share of bytes more than the winner.
MARGIN = 0.002
UNKNOWN = "und"
#: Letters of context of the fractional code lengths.
ORDER, UNSEEN_BITS = 3, 20.0
NO_LETTERS = re.compile(r"[\W\d_]+")


def words_of(text: str) -> str:
    return NO_LETTERS.sub(" ", text.lower())


def has_letter(text: str | None) -> bool:
    """Whether a text holds a letter; a number's sign, ½ or Ⅷ, is none."""
    return any(map(str.isalpha, text or ""))


def held_out(id_col: str) -> Column:
    """crc32 of the id as text, mod 3, is 1."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def dictionaries(df: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", rows: int = SAMPLE_ROWS) -> dict[str, bytes]:
    """Raw dictionary content by language, from labelled rows that are not held out.

    Bounded: about ``rows`` rows of each language, all of a language with fewer, and at most
    MOST_LANGUAGES languages, beyond which it raises; their whole texts are learned. Counting
    is a partial aggregate; a language's rate, against each row's hash, then names the rows
    that come to the driver.
    """
    known = df.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"), held_out(id_col).alias("held"))
    known = known.where("lang is not null and text is not null and not coalesce(held, false) and text rlike '\\\\p{L}'")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: group the labels")
    if not counts:
        return {}
    rate = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, rows / n)))])
    spin = F.xxhash64("i", "text")
    some = known.where(F.pmod(spin, F.lit(1 << 30)) < F.element_at(rate, F.col("lang")) * (1 << 30))
    found: dict[str, list[tuple[int, str]]] = {k: [] for k in sorted(counts)}
    for r in some.select("lang", spin.alias("h"), "text").collect():
        found[r["lang"]].append((r["h"], r["text"]))
    return {k: " ".join(words_of(t) for _, t in sorted(texts)).encode() or b" " for k, texts in found.items()}


class CodeLengths:
    """Bits of a text by the letter sequences of one language's dictionary.

    A letter's chance after the ORDER letters before it blends its share after ever shorter
    contexts, each weighed by its count against its distinct successors (Witten-Bell). A letter
    the dictionary lacks costs the same in every language, and a space after it nothing, so a
    text in letters that no language has tells them not apart.
    """

    def __init__(self, content: bytes):
        text = f" {content.decode(errors='ignore')} "
        self.counts = [Counter(text[i : i + n] for i in range(len(text) - n + 1)) for n in range(1, ORDER + 2)]
        self.seen, self.kinds = [], []
        for grams in self.counts:
            seen, kinds = Counter(), Counter()
            for gram, n in grams.items():
                seen[gram[:-1]] += n
                kinds[gram[:-1]] += 1
            self.seen.append(seen)
            self.kinds.append(kinds)

    def bits(self, words: str) -> float:
        text, total = f" {words.strip()} ", 0.0
        for i in range(1, len(text)):
            if text[i] not in self.counts[0]:
                total += UNSEEN_BITS
                continue
            if text[i] == " " and text[i - 1] not in self.counts[0]:
                continue
            chance = 2.0**-UNSEEN_BITS
            for n in range(min(i, ORDER) + 1):
                context = text[i - n : i]
                if not (seen := self.seen[n][context]):
                    break
                kinds = self.kinds[n][context]
                chance = (self.counts[n][context + text[i]] + kinds * chance) / (seen + kinds)
            total -= math.log2(chance)
        return total


class Classifier:
    def __init__(self, content: dict[str, bytes]):
        import zstandard

        self.langs = sorted(content)
        self.content = content
        self.lengths: dict[str, CodeLengths] = {}
        self.compressors = []
        for k in self.langs:
            d = zstandard.ZstdCompressionDict(content[k].ljust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin); the margin is what the runner-up needs more, as a share of the winner."""
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0, 0.0
        words = words_of(text)
        data = words.encode()
        chunks = [data[i : i + CHUNK_BYTES] for i in range(0, len(data), CHUNK_BYTES)]
        sizes = [sum([len(c.compress(x)) for x in chunks]) for c in self.compressors]
        least = min(sizes)
        at = sizes.index(least)
        rest = min(sizes[:at] + sizes[at + 1 :], default=2 * least)
        margin = (rest - least) / least
        if rest == least and least * MARGIN < 1:
            return self.tied(words, [k for k, n in zip(self.langs, sizes) if n == least])
        return self.langs[at], min(1.0, 0.5 + 2.5 * margin), margin


    def tied(self, words: str, langs: list[str]) -> tuple[str, float, float]:
        """As predict, for the languages whose sizes in bytes are equal, by fractional code lengths."""
        for k in langs:
            if k not in self.lengths:
                self.lengths[k] = CodeLengths(self.content[k])
        bits = sorted((self.lengths[k].bits(words), k) for k in langs)
        margin = (bits[1][0] - bits[0][0]) / bits[0][0]
        return bits[0][1], min(1.0, 0.5 + 2.5 * margin), margin


_LOADED: dict[int, tuple[dict[str, bytes], Classifier]] = {}


def identify(df: DataFrame, content: dict[str, bytes], text: str = "text", keep: list[str] | None = None, margin: float = MARGIN, prefix: str = "") -> DataFrame:
    """Columns ``keep``, then lang_pred, score (0 to 1), margin and rejected, their names after ``prefix``.

    lang_pred is a learned language, or ``und`` for a null text or one without a letter;
    score is 0 then. rejected: such a text, or a margin below ``margin``; with no language
    learned every text is ``und`` and only those without a letter are rejected. A tie in bytes, of a
    text too short for bytes to show the margin, is decided by fractional code lengths, margin
    included; any other tie goes to the language first in order, with margin 0, so it is rejected. One narrow pass: the
    dictionaries (SAMPLE_ROWS texts a language) go out with the function. Whole texts are
    compressed, of any length. Rows, nulls and repeats are kept; an empty table gives an
    empty one; other columns are not read.
    """
    keep = keep or ["doc_id"]
    results = [prefix + c for c in ("lang_pred", "score", "margin", "rejected")]
    names = [f"_c{i}" for i in range(len(keep))]
    schema = ", ".join(f"{n} {df.schema[c].dataType.simpleString()}" for n, c in zip(names, keep))
    sent = df.sparkSession.sparkContext.broadcast(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _LOADED.get(0) is None or _LOADED[0][0] != sent.value:
            _LOADED[0] = (sent.value, Classifier(sent.value))
        model = _LOADED[0][1]
        for batch in batches:
            texts = batch.column(at)
            found = [model.predict(t.as_py()) for t in texts]
            lang, score, gap = ([x[i] for x in found] for i in range(3))
            rejected = [not has_letter(t.as_py()) or bool(model.langs) and g < margin for t, g in zip(texts, gap)]
            out = [*batch.columns[: len(keep)], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(gap, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.record_batch(out, names=[*names, *results])

    chosen = [F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)]
    # a kept text goes to Python once
    has_text = text in keep and df.schema[text].dataType.simpleString() == "string"
    at = keep.index(text) if has_text else len(keep)
    out = arrow_rows(df, chosen if has_text else [*chosen, F.col(f"`{text}`").cast("string").alias("_text")], run, f"{schema}, " + ", ".join(f"`{c}` {t}" for c, t in zip(results, ("string", "double", "double", "boolean"))))
    return out.withColumnsRenamed(dict(zip(names, keep)))
