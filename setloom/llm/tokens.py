"""Token counts and token ids by a public tokenizer file, exact and batched.

A text is cut at boundaries that no pre-token of the file's pattern can cross, so the sum
over parts equals the whole text's encoding, for texts of any length. A slice of texts of
bounded bytes is one batch: Arrow cuts it and numbers its distinct parts, which are encoded
once, plain words by ``BatchMerger``, which runs the file's merges over all words at once in
numpy, everything else (other scripts, special strings, odd white space, very long words) by
the library itself. Parts, ids and lengths stay in flat arrays; nothing is kept between batches.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setloom.llm.common import arrow_rows, by_bytes

SPACE_THEN_WORD = re.compile(r" (?=\S)")
#: Separators that Python's str.split() takes for white space and Unicode's White_Space does not.
ONLY_PYTHON_SPACE = re.compile("[\x1c-\x1f]")
LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
#: All but the characters on which Python's and Arrow's classes, case and composition agree with the library's, in a part
#: and in a whole text, where Arrow may cut at other white space too.
ODD_IN_PART, ODD_IN_TEXT = "[^\n -~À-ÖØ-öø-ÿ]", "[^\t\n\r -~À-ÖØ-öø-ÿ]"
SPACED_TOKENS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[0-9]+| ?[^\s0-9{LETTER}]+|\s+(?!\S)|\s+")
BARE_TOKENS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[0-9]|[^\s0-9{LETTER}]+")
#: A word, and a word with marks behind it, none of which can begin another pre-token.
WORD, WORD_AND_MARKS = f"^[{LETTER}]+$", f"^(?P<word>[{LETTER}]+)(?P<marks>[!-&(-/:-@\\[-`{{-~]+)$"
#: Bytes of a batch, and of the longest word that numpy merges: a round merges one pair a word.
BATCH_BYTES, WORD_BYTES = 4 << 20, 64
NONE = np.iinfo(np.int32).max


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else the next from 256 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class PairRanks:
    """Rank of a pair of ids by hashing, for arrays: a key that meets an occupied slot goes to the next, smaller table."""

    def __init__(self, keys: np.ndarray):
        left, bits = np.arange(len(keys), dtype=np.int32), max(8, int(len(keys)).bit_length() + 2)
        self.tables: list[tuple[np.uint64, np.uint64, np.ndarray, np.ndarray]] = []
        factor = 0x9E3779B97F4A7C15
        while len(left):
            odd, shift = np.uint64(factor), np.uint64(64 - bits)
            slot = (keys[left].view(np.uint64) * odd) >> shift
            _, first = np.unique(slot, return_index=True)
            held, rank = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
            held[slot[first]], rank[slot[first]] = keys[left[first]], left[first]
            self.tables.append((odd, shift, held, rank))
            left = np.delete(left, first)
            bits, factor = max(8, bits - 2), (factor * 0xD1342543DE82EF95 & (1 << 64) - 1) | 1

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        out, at = np.full(len(key), NONE, np.int32), None
        for odd, shift, held, rank in self.tables:
            some = key if at is None else key[at]
            slot = (some.view(np.uint64) * odd) >> shift
            have = held[slot]
            if at is None:
                out = np.where(have == some, rank[slot], NONE)
                at = np.flatnonzero((have != some) & (have >= 0))
            else:
                hit = have == some
                out[at[hit]] = rank[slot[hit]]
                at = at[~hit & (have >= 0)]
            if not len(at):
                break
        return out


class BatchMerger:
    """Byte-pair merging of many words at once: each round merges, in every word, its leftmost pair of least rank."""

    def __init__(self, model: dict):
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        symbols = byte_symbols()
        self.first = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + end] for s in symbols], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = PairRanks(np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64))
        self.into = np.array([vocab[a + b] for a, b in merges], np.int64)

    def encode(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each word has. ``raw`` holds the words' bytes; no word is empty."""
        ids = self.first[raw]
        ends = np.cumsum(size) - 1
        ids[ends] = self.last[raw[ends]]
        word = np.repeat(np.arange(len(size), dtype=np.int32), size)
        rank = np.full(len(ids), NONE, np.int32)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self.rank(ids[inner], ids[inner + 1])
        span = size.astype(np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            starts = np.cumsum(span) - span
            least = np.minimum.reduceat(rank, starts)
            if (least == NONE).any():
                live = np.repeat(least != NONE, span)
                done.append((word[~live], ids[~live]))
                ids, word, rank = ids[live], word[live], rank[live]
                span, least = span[least != NONE], least[least != NONE]
                if not len(ids):
                    break
            hits = np.flatnonzero(rank == np.repeat(least, span))
            hits = hits[np.r_[True, word[hits[1:]] != word[hits[:-1]]]]
            ids[hits] = self.into[rank[hits]]
            keep = np.ones(len(ids), bool)
            keep[hits + 1] = False
            at = hits - np.arange(len(hits))
            ids, word, rank = ids[keep], word[keep], rank[keep]
            span = span - 1
            rank[at] = NONE
            for left in (at - 1, at):
                left = left[(left >= 0) & (left + 1 < len(ids))]
                left = left[word[left] == word[left + 1]]
                rank[left] = self.rank(ids[left], ids[left + 1])
        words_of = np.concatenate([w for w, _ in done]) if done else np.empty(0, np.int32)
        all_ids = np.concatenate([i for _, i in done]) if done else np.empty(0, np.int64)
        order = np.argsort(words_of, kind="stable")
        return all_ids[order].astype("<u4"), np.bincount(words_of, minlength=len(size))


def spread(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs ``which`` of ``values``, end to end; run i begins at starts[i] and has sizes[i] members."""
    size = sizes[which]
    end = np.cumsum(size)
    return values[np.repeat(starts[which] - end + size, size) + np.arange(end[-1] if len(end) else 0)]


def bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array without nulls, end to end, and the size of each."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = words.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(words) else np.empty(0, np.uint8)
    return raw, np.diff(offsets)


def flat(array: pa.Array | pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(array.chunks) if isinstance(array, pa.ChunkedArray) else array


class Parts:
    """Ids of texts under one tokenizer, by the distinct parts of a batch.

    ``spaced``: the file is byte-level with an optional leading space in its pattern.
    Otherwise the file drops white space and lower-cases.
    """

    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.merger = BatchMerger(file["model"])
        self.special = [t["content"] for t in file["added_tokens"]]
        self.spaced = spaced

    def cut(self, text: str) -> list[str]:
        if self.spaced:
            # a space before what isn't white space always begins a pre-token; parts lose it, and only the first starts with one
            parts = SPACE_THEN_WORD.split(text)
            parts[0] = " " + parts[0]
            return parts
        return text.split() if ONLY_PYTHON_SPACE.search(text) is None else [text]

    def whole(self, part: str) -> str:
        if not self.spaced:
            return part
        return part[1:] if part[:1] == " " else " " + part

    def cut_all(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The parts of all texts in order, and how many each text has."""
        odd = pc.match_substring_regex(texts, ODD_IN_TEXT)
        if self.spaced:
            odd = pc.or_(odd, pc.match_substring_regex(texts, " [ \t\n\r]"))
        odd_at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(odd_at):  # Arrow cuts them too, and those cuts are not used
            cuts = [self.cut(t) for t in texts.take(pa.array(odd_at)).to_pylist()]
        lists = pc.split_pattern(texts, " ") if self.spaced else pc.ascii_split_whitespace(texts)
        starts = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1].astype(np.int64)
        parts, sizes, starts = lists.values, np.diff(starts), starts[:-1]
        if self.spaced:  # mark the first part of each text
            first = np.zeros(len(parts), bool)
            first[starts] = True
            parts = pc.replace_with_mask(parts, pa.array(first), pc.binary_join_element_wise(" ", parts.take(pa.array(starts)), ""))
        if not len(odd_at):
            return parts, sizes
        starts, sizes = starts.copy(), sizes.copy()
        sizes[odd_at] = [len(c) for c in cuts]
        starts[odd_at] = len(parts) + np.cumsum(sizes[odd_at]) - sizes[odd_at]
        both = flat(pa.chunked_array([parts, pa.array([p for c in cuts for p in c], pa.string())]))
        return both.take(pa.array(spread(np.arange(len(both)), starts, sizes, np.arange(len(texts))))), sizes

    def encode_parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each part's begin, how many it has) of distinct parts."""
        n = len(parts)
        found = np.zeros(n, bool)
        short = pc.less_equal(pc.binary_length(parts), WORD_BYTES)

        def choose(mask: pa.Array) -> np.ndarray:
            at = np.flatnonzero(pc.and_(mask, short).to_numpy(zero_copy_only=False) & ~found)
            found[at] = True
            return at

        lower = (lambda x: x) if self.spaced else pc.utf8_lower
        lead = (lambda x: pc.binary_join_element_wise(" ", x, "")) if self.spaced else lower
        # pre-tokens, and of each run of parts how many they have
        tokens: list[pa.Array] = []
        who: list[np.ndarray] = []
        many: list[np.ndarray] = []
        at = choose(pc.match_substring_regex(parts, WORD))
        tokens.append(lead(parts.take(pa.array(at))))
        who.append(at)
        many.append(np.ones(len(at), np.int64))
        at = choose(pc.match_substring_regex(parts, WORD_AND_MARKS.replace("?P<word>", "").replace("?P<marks>", "")))
        split = pc.extract_regex(parts.take(pa.array(at)), WORD_AND_MARKS)
        pairs = pa.concat_arrays([lead(split.field("word")), split.field("marks")])
        tokens.append(pairs.take(pa.array(np.arange(2 * len(at)).reshape(2, -1).T.ravel())))
        who.append(at)
        many.append(np.full(len(at), 2))
        plain = pc.invert(pc.match_substring_regex(parts, ODD_IN_PART))
        for s in self.special:
            plain = pc.and_(plain, pc.invert(pc.match_substring(parts, s)))
        at = choose(plain)
        cut = SPACED_TOKENS if self.spaced else BARE_TOKENS
        mixed = [cut.findall(w if self.spaced else w.lower()) for w in map(self.whole, parts.take(pa.array(at)).to_pylist())]
        tokens.append(pa.array([t for ts in mixed for t in ts], pa.string()))
        who.append(at)
        many.append(np.fromiter(map(len, mixed), np.int64, len(mixed)))
        # each distinct pre-token once
        coded = pa.concat_arrays(tokens).dictionary_encode()
        token_ids, token_sizes = self.merger.encode(*bytes_of(coded.dictionary))
        which = coded.indices.to_numpy()
        ids = spread(token_ids, np.cumsum(token_sizes) - token_sizes, token_sizes, which)
        ends = np.r_[0, np.cumsum(token_sizes[which])]
        last = np.cumsum(np.concatenate(many))
        at, bounds = np.concatenate(who), ends[np.r_[0, last]]
        starts, sizes = np.zeros(n, np.int64), np.zeros(n, np.int64)
        starts[at], sizes[at] = bounds[:-1], np.diff(bounds)
        rest = np.flatnonzero(~found)
        if len(rest):
            texts = [self.whole(p) for p in parts.take(pa.array(rest)).to_pylist()]
            by_library = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            sizes[rest] = [len(x) for x in by_library]
            starts[rest] = len(ids) + np.cumsum(sizes[rest]) - sizes[rest]
            ids = np.concatenate([ids, *by_library])
        return ids, starts, sizes

    def encode(self, texts: pa.Array, only_sizes: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty), end to end, and how many each text has."""
        texts = pc.fill_null(texts, "")
        parts, sizes = self.cut_all(texts)
        coded = parts.dictionary_encode()
        ids, at, size = self.encode_parts(coded.dictionary)
        which = coded.indices.to_numpy()
        ends = np.r_[0, np.cumsum(size[which])]
        bounds = ends[np.r_[0, np.cumsum(sizes)]]
        return (ids[:0] if only_sizes else spread(ids, at, size, which)), np.diff(bounds)

    def of(self, texts: list[str]) -> list[list]:
        """For each text a list of its value: the number of ids if ``spaced``, else the ids as little-endian bytes."""
        ids, sizes = self.encode(pa.array(texts, pa.string()))
        if self.spaced:
            return [[n] for n in sizes.tolist()]
        return [[x.tobytes()] for x in np.split(ids, np.cumsum(sizes)[:-1])] if texts else []


_LOADED: dict[tuple, Parts] = {}


def parts(path: str, spaced: bool) -> Parts:
    """One per worker process: a worker serves many tasks."""
    if (path, spaced) not in _LOADED:
        _LOADED[path, spaced] = Parts(path, spaced)
    return _LOADED[path, spaced]


def token_counts(df: DataFrame, tokenizer: str, text: str = "text", id_col: str = "doc_id", limit: int = 1024) -> DataFrame:
    """Bytes and tokens of every whole text, by a byte-level BPE file of the library ``tokenizers``.

    Returns (id_col, n_bytes, n_tokens, over_limit), a row for each row of ``df`` in no set
    order. Null text counts as empty (0, 0, false); a null id stays null; repeated rows give
    repeated rows; an empty table gives an empty one; other columns are not read, whatever
    their names. One narrow pass without a shuffle: only lengths leave Python.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = parts(tokenizer, True)
        for batch in batches:
            sizes = [model.encode(some.column(1), only_sizes=True)[1] for some in by_bytes(batch, 1, BATCH_BYTES)]
            n = np.concatenate(sizes) if sizes else np.empty(0, np.int64)
            n_bytes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.record_batch([batch.column(0), n_bytes, pa.array(n, pa.int64()), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return arrow_rows(df, [F.col(id_col), F.col(text).cast("string")], count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
