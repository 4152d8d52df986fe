"""Collocations by Toivonen mining: a sample proposes, full passes count and correct.

A phrase is a run of 1 to ``max_words`` words within a piece of a text. No phrase is more
frequent than the phrases it is made of, so a phrase of n words can only be frequent if
its first and its last n - 1 words are. A sample of blocks of text, from every document,
is mined level by level with a lowered threshold. What it finds frequent is proposed; its
negative border are the phrases that are not proposed, but whose first and last n - 1 words
are, and every single word. One full pass counts the proposed phrases and the border as
they occur. If no phrase of the border turns out frequent, every frequent phrase has been
counted. If a few do, one further pass counts all phrases that they are part of, at every
length: any other frequent phrase is made of proposed ones and has been counted. If many do
(more than one for ``FEW`` proposed), that pass could have nearly every phrase to count; then
they join the proposed ones, and passes count what that lets
in and has not been counted yet, until no more phrase fails. Each pass can only fail on
longer phrases than the one before, so there are at most ``max_words`` passes. A phrase
that owes its count to a few places, which a sample misses, is also proposed where a slice
of text has it often, with all that it is part of there: one more pass then suffices.

These passes count phrases by a key that is the phrase itself: two bytes a word, which
number the words that are frequent in the sample, ``MOST_KNOWN`` of them at most. A phrase
with any other word has its text as key. A pass leaves a phrase out wherever it occurs or
nowhere, and a later pass leaves out what was counted before, so each count is exact and
whole, and no pass has to count the frequent phrases again. Their words are told from
the keys, once for each phrase, whatever the number of tasks that have met it.

Sets of phrases reach the workers as a bitmap of ``BITMAP_BITS`` bits of their hashes,
however many they are. Two phrases may share a bit or a hash: then a few more phrases are
counted than need be, by every task alike, and their counts are dropped for being low. No
result depends on the sample, the numbers or the hashes.

Counts of slices are summed by Spark. Everything after that works on the frequent phrases:
the parts of a phrase are looked up with ``attach``, since one word may be part of a
large share of all phrases.

Defined results: a null text is empty; a null language is ``und``; words and pieces are
divided at the characters of the contract only; repeated rows count as often as they
occur; extra columns are not read; without a frequent phrase there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readyscope.llm.common import attach, freeing_shuffles, lean, stored

MAX_WORDS = 5
MIN_COUNT = 100
TOP = 2000
SHARE = 100  # a phrase goes if a longer one has this many hundredths of its count
UNKNOWN_LANG = "und"
# One block of text in this many is in the sample, and blocks have about so many bytes; a
# phrase is proposed from this part of its expected count there
SAMPLE_EVERY = 8
BLOCK = 400
CAUTION = 0.4
OFTEN = 4  # times rarer than frequent, and still often in a slice
FEW = 10  # proposed phrases for one that failed
BITMAP_BITS = 1 << 26
SLICE = 3_000_000  # bytes of text that are worked on at a time
HELD = 250_000  # phrases of which a task adds up the counts of slices, some 200 bytes each

_MARK = b"\xff"  # between pieces; no byte of UTF-8
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else 255 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256)
)
_MIX = np.uint64(0x9E3779B97F4A7C15)
# The lowest bits of a hash hold the number of words
_LEVEL_BITS = 3
# What a key starts with that is no list of word numbers: the text of a phrase, the hash of
# one to propose, or a language, for all its words. The numbers stay below that.
_TEXT, _PROPOSE, _TOTAL = b"\xff", b"\xfe", b"\xfd"
MOST_KNOWN = 0xFD00
# From a slice to Spark; the null phrase holds the number of all words
HASHED, KEYED, EXACT = "hash long, n long", "key binary, n long", "lang string, n_words int, phrase string, n long"


class _Numbers(dict):
    """Numbers things in the order they come."""

    def __missing__(self, key):
        value = self[key] = len(self)
        return value


class Bitmap:
    """The hashes that are proposed, with false hits but no false misses."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def empty(cls) -> Bitmap:
        return cls(np.zeros(BITMAP_BITS // 64, np.uint64))

    def __or__(self, other: Bitmap) -> Bitmap:
        return Bitmap(self.words | other.words)

    def without(self, other: Bitmap) -> Bitmap:
        return Bitmap(self.words & ~other.words)

    def size(self) -> int:
        """The bits that are set."""
        return int(np.bitwise_count(self.words).sum())

    def has(self, hashes: np.ndarray) -> np.ndarray:
        bit = hashes >> np.uint64(_LEVEL_BITS) & np.uint64(64 * len(self.words) - 1)
        return (self.words[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)


def bitmap_of(hashes: DataFrame) -> Bitmap:
    """Of the column ``hash``. At most ``BITMAP_BITS`` / 64 rows come to the driver."""
    bit = F.shiftrightunsigned("hash", _LEVEL_BITS).bitwiseAND(F.lit(BITMAP_BITS - 1))
    hashes = hashes.select(bit.alias("bit"))
    word, flag = F.shiftright("bit", 6), F.expr("shiftleft(1L, cast(bit & 63L as int))")
    rows = hashes.groupBy(word.alias("word")).agg(F.bit_or(flag).alias("bits")).toPandas()
    found = Bitmap.empty()
    found.words[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return found


@np.errstate(over="ignore")
def _mixed(a: np.ndarray, b: np.ndarray, n_words: int) -> np.ndarray:
    x = (a ^ (a >> np.uint64(31))) * _MIX + b
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return _marked(x ^ (x >> np.uint64(32)), n_words)


def _marked(hashes: np.ndarray, n_words: int) -> np.ndarray:
    return hashes & ~np.uint64((1 << _LEVEL_BITS) - 1) | np.uint64(n_words)


def word_lists(texts: list[bytes], max_words: int, size: int = SLICE) -> Iterator[tuple[list[bytes], int]]:
    """Lists of words, with marks between pieces, and how many words were in the list before.

    Texts share a list up to ``size`` bytes. A longer text has lists of its own, cut behind
    a blank, and each goes on with the last ``max_words`` - 1 words of the one before, so
    that every phrase ends in the new part of exactly one list.
    """
    held, n = [], 0
    for text in texts:
        octets = text.translate(_TABLE).replace(_MARK, b" \xff ")
        if len(octets) <= size:
            held.append(octets)
            n += len(octets)
            if n >= size:
                yield b" \xff ".join(held).split(), 0
                held, n = [], 0
            continue
        carried, at = [], 0
        while at < len(octets):
            end = octets.find(b" ", at + size) + 1 or len(octets)
            words = carried + octets[at:end].split()
            yield words, len(carried)
            carried, at = words[max(0, len(words) - max_words + 1) :], end
    if held:
        yield b" \xff ".join(held).split(), 0


class Words:
    """A list of words and marks as numbers, with the hash of each place's word."""

    def __init__(self, words: list[bytes], lang: str):
        numbers = _Numbers()
        numbers[_MARK] = 0
        self.words = words
        self.at = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        self.distinct = list(numbers)
        self.hashes = word_hashes(self.distinct, lang)[self.at]


def word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang)
    return _marked(np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words)), 1)


class Known:
    """The (lang, word) pairs that have a number, and the keys of phrases."""

    def __init__(self, pairs: list[tuple[str, bytes]]):
        self.pairs = pairs[:MOST_KNOWN]
        self.numbers: dict[str, dict[bytes, int]] = {}
        for number, (lang, word) in enumerate(self.pairs):
            self.numbers.setdefault(lang, {})[word] = number

    def in_list(self, words: Words, lang: str) -> np.ndarray:
        """The number of each distinct word, or -1."""
        numbers = self.numbers.get(lang, {})
        return np.fromiter((numbers.get(w, -1) for w in words.distinct), np.int64, len(words.distinct))

    def keys(self, words: Words, own: np.ndarray, lang: str, n: int, begins: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """Of the phrases of ``n`` words at some places, and those places' order there."""
        numbers, short = np.empty((len(begins), n), ">u2"), np.ones(len(begins), bool)
        for k in range(n):
            column = own[words.at[begins + k]]
            short &= column >= 0
            numbers[:, k] = np.maximum(column, 0)
        octets = numbers[short].tobytes()
        ends = np.arange(0, len(octets) + 1, 2 * n, dtype=np.int32)
        buffers = [None, pa.py_buffer(ends), pa.py_buffer(octets)]
        keys = [pa.Array.from_buffers(pa.binary(), len(ends) - 1, buffers)]
        if not short.all():
            head = _TEXT + lang.encode() + _MARK
            spelled = [head + b" ".join(words.words[b : b + n]) for b in begins[~short].tolist()]
            keys.append(pa.array(spelled, pa.binary()))
        return pa.concat_arrays(keys), np.argsort(~short, kind="stable")

    def phrase(self, key: bytes) -> tuple[str, list[bytes]]:
        """The language and the words of a key."""
        if key[:1] == _TEXT:
            lang, _, text = key[1:].partition(_MARK)
            return lang.decode(), text.split(b" ")
        pairs = [self.pairs[number] for number in np.frombuffer(key, ">u2").tolist()]
        return pairs[0][0], [word for _, word in pairs]


def phrases_in(
    words: Words, max_words: int, proposed: Bitmap, before: Bitmap | None = None, often: int | None = None
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(number of words, places, hashes, hashes to propose) of the phrases whose first and
    last words but one are proposed, without those for which that was so ``before``, all
    words included. To propose are those that occur ``often`` here, if that is asked for,
    whether or not their parts are proposed."""
    hashes = words.hashes
    place = np.flatnonzero(words.at > 0)
    counted, seen = np.ones(len(place), bool), np.full(len(place), before is not None)
    for n in range(1, max_words + 1):
        if n > 1:
            place = np.flatnonzero((likely[:-1] & likely[1:])[: max(0, len(words.at) - n + 1)])
            counted = ready[place] & ready[place + 1]
            seen = np.zeros(len(place), bool)
            if before is not None:
                seen = was_ready[place] & was_ready[place + 1]
            longer = np.zeros_like(hashes)
            longer[place] = _mixed(hashes[place], words.hashes[place + n - 1], n)
            hashes = longer
        if not len(place):
            return
        own = hashes[place]
        # whether longer phrases may be made of it, now and in the passes before
        known = proposed.has(own)
        ready = np.zeros(len(words.at), bool)
        ready[place] = known & counted
        if before is not None:
            was_ready = np.zeros(len(words.at), bool)
            was_ready[place[seen]] = before.has(own[seen])
        likely, new = ready, own[:0]
        if often is not None:
            code, keys = pd.factorize(own[~known])
            many = np.bincount(code, minlength=len(keys)) >= often
            new, likely = keys[many], ready.copy()
            likely[place[~known]] = many[code]
            likely[place[known]] = True
        yield n, place[counted & ~seen], own[counted & ~seen], new


def phrases_around(
    words: Words, max_words: int, frequent: Bitmap, missed: Bitmap
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """As ``phrases_in``, the phrases that some ``missed`` phrase is part of and whose first
    and last words but one are frequent or, since such a phrase is part of them too, unknown.
    Nothing is proposed."""
    hashes = words.hashes
    place = np.flatnonzero(words.at > 0)
    counted = np.zeros(len(place), bool)
    for n in range(1, max_words + 1):
        if n > 1:
            place = np.flatnonzero((likely[:-1] & likely[1:])[: max(0, len(words.at) - n + 1)])
            counted = around[place] | around[place + 1]
            longer = np.zeros_like(hashes)
            longer[place] = _mixed(hashes[place], words.hashes[place + n - 1], n)
            hashes = longer
        if not len(place):
            return
        own = hashes[place]
        likely, around = np.zeros(len(words.at), bool), np.zeros(len(words.at), bool)
        likely[place] = counted | frequent.has(own)
        around[place] = counted | missed.has(own)
        yield n, place[counted], own[counted], own[:0]


def count_hashes(
    docs: DataFrame, max_words: int, proposed: Bitmap, before: Bitmap | None = None,
    levels: tuple[int, ...] | None = None, often: int | None = None, as_much: int = 0, size: int = SLICE,
    missed: Bitmap | None = None, known: Known | None = None,
) -> DataFrame:
    """``HASHED`` rows of (lang, text as bytes), or ``KEYED`` ones where words are ``known``,
    not yet summed over slices. What occurs ``often`` in a slice without being proposed has a
    row of its own there, with a count of ``as_much``. With ``missed``, the phrases around
    those instead, where ``proposed`` is what is frequent. The first pass by keys also counts
    all words."""

    def found_in(words: Words):
        if missed is not None:
            return phrases_around(words, max_words, proposed, missed)
        return phrases_in(words, max_words, proposed, before, often)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _by_lang(batches, size):
            for words, carried in word_lists(texts, max_words, size):
                for n, place, hashes, new in found_in(Words(words, lang)):
                    if levels is None or n in levels:
                        code, keys = pd.factorize(hashes[place + n > carried])
                        yield _hash_rows(keys, np.bincount(code, minlength=len(keys)))
                        if len(new):
                            yield _hash_rows(new, np.full(len(new), as_much))

    def read_keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _by_lang(batches, size):
            for words, carried in word_lists(texts, max_words, size):
                if before is None and missed is None:
                    yield _key_rows(pa.array([_TOTAL + lang.encode()], pa.binary()), np.array([_total(words, carried)]))
                listed = Words(words, lang)
                own = known.in_list(listed, lang)
                for n, place, hashes, new in found_in(listed):
                    fresh = place + n > carried
                    begins, counts = _different(listed, n, place[fresh], hashes[fresh])
                    keys, order = known.keys(listed, own, lang, n, begins)
                    yield _key_rows(keys, counts[order])
                    if len(new):
                        told = [_PROPOSE + h.tobytes() for h in new.astype("<u8")]
                        yield _key_rows(pa.array(told, pa.binary()), np.full(len(new), as_much))

    return docs.mapInArrow(read, HASHED) if known is None else docs.mapInArrow(read_keyed, KEYED)


def _hash_rows(hashes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(hashes.view(np.int64)), pa.array(counts.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, ["hash", "n"])


def _key_rows(keys: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([keys, pa.array(counts.astype(np.int64))], ["key", "n"])


def _total(words: list[bytes], carried: int) -> int:
    return len(words) - carried - words[carried:].count(_MARK)


def _different(words: Words, n: int, place: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each phrase of ``n`` words, and how often it is at these places."""
    code, keys = pd.factorize(hashes)
    begins = np.zeros(len(keys), np.int64)
    begins[code[::-1]] = place[::-1]
    if any(np.any(words.at[place + k] != words.at[begins[code] + k]) for k in range(n)):
        # two phrases of one hash in a slice: by their words instead
        listed = words.at[place[:, None] + np.arange(n)]
        _, first, counts = np.unique(listed, axis=0, return_index=True, return_counts=True)
        return place[first], counts
    return begins, np.bincount(code, minlength=len(keys))


def told(keyed: DataFrame, known: Known) -> DataFrame:
    """lang, n_words, phrase, n and hash of keys and their sums: a row for each. What is only
    to be proposed has no phrase, and the number of all words no phrase and no hash."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[tuple[str | None, int], tuple[list, list]] = {}
            for key, n in zip(batch.column("key").to_pylist(), batch.column("n").to_pylist(), strict=True):
                if key[:1] == _PROPOSE:
                    group, item = (None, key[1] & (1 << _LEVEL_BITS) - 1), int.from_bytes(key[1:], "little", signed=True)
                elif key[:1] == _TOTAL:
                    group, item = (key[1:].decode(), 0), None
                else:
                    lang, item = known.phrase(key)
                    group = (lang, len(item))
                items, counts = rows.setdefault(group, ([], []))
                items.append(item)
                counts.append(n)
            for (lang, n_words), (items, counts) in rows.items():
                phrases, hashes = [None] * len(items), items
                if lang is not None and n_words:
                    phrases = [b" ".join(words) for words in items]
                    hashes = _phrase_hashes(items, lang).view(np.int64)
                yield _rows(lang, n_words, phrases, np.array(counts)).append_column("hash", pa.array(hashes, pa.int64()))

    return keyed.mapInArrow(read, f"{EXACT}, hash long")


def _phrase_hashes(phrases: list[list[bytes]], lang: str) -> np.ndarray:
    """Of phrases that have the same number of words."""
    ones = [word_hashes(list(words), lang) for words in zip(*phrases, strict=True)]
    hashes = ones[0]
    for n, last in enumerate(ones[1:], 2):
        hashes = _mixed(hashes, last, n)
    return hashes


def exact_counts(
    words: list[bytes], carried: int, lang: str, max_words: int, wanted: Bitmap
) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """(number of words, phrases, counts) of the phrases that are wanted with all their parts."""
    own = Words(words, lang)
    for n, place, hashes, _ in phrases_in(own, max_words, wanted):
        counted = (place + n > carried) & wanted.has(hashes)
        begins, counts = _different(own, n, place[counted], hashes[counted])
        yield n, [b" ".join(words[b : b + n]) for b in begins.tolist()], counts


def count_phrases(docs: DataFrame, max_words: int, wanted: Bitmap, size: int = SLICE, most: int = HELD) -> DataFrame:
    """``EXACT`` rows of (lang, text as bytes), summed over slices of a task until it holds
    ``most`` phrases."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], dict[bytes | None, int]] = {}
        for lang, texts in _by_lang(batches, size):
            for words, carried in word_lists(texts, max_words, size):
                _add(held, lang, 0, [None], [_total(words, carried)])
                for n, found, counts in exact_counts(words, carried, lang, max_words, wanted):
                    _add(held, lang, n, found, counts.tolist())
                if sum(map(len, held.values())) >= most:
                    yield from _held_rows(held)
                    held.clear()
        yield from _held_rows(held)

    return docs.mapInArrow(read, EXACT)


def _add(held: dict, lang: str, n: int, phrases: list[bytes | None], counts: list[int]) -> None:
    sums = held.setdefault((lang, n), {})
    for phrase, count in zip(phrases, counts, strict=True):
        sums[phrase] = sums.get(phrase, 0) + count


def _held_rows(held: dict) -> Iterator[pa.RecordBatch]:
    for (lang, n), sums in held.items():
        yield _rows(lang, n, list(sums), np.fromiter(sums.values(), np.int64, len(sums)))


def _by_lang(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of one language at a time, about ``size`` bytes of them or all that are left."""
    held: dict[str, list[bytes]] = {}
    n: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            held.setdefault(lang, []).append(text)
            n[lang] = n.get(lang, 0) + len(text)
        # all languages together stay below two slices
        while sum(n.values()) >= size:
            most = max(n, key=n.get)
            yield most, held.pop(most)
            del n[most]
    yield from held.items()


def _rows(lang: str, n: int, phrases: list[bytes | None], counts: np.ndarray) -> pa.RecordBatch:
    k = len(counts)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([lang] * k, pa.string()), pa.array(np.full(k, n, np.int32)),
            pa.array(phrases, pa.binary()).view(pa.string()), pa.array(counts.astype(np.int64)),
        ],
        ["lang", "n_words", "phrase", "n"],
    )


def sample_blocks(docs: DataFrame, every: int, block: int = BLOCK) -> DataFrame:
    """(lang, text) of blocks of text, cut at blanks: one in ``every``, chosen by their own
    bytes, document and place, so that no document or group of copies is in it as a whole."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, chosen = [], []
            rows = zip(*(batch.column(c).to_pylist() for c in ("lang", "text", "doc_key")), strict=True)
            for lang, text, key in rows:
                at = 0
                while at < len(text):
                    end = text.find(b" ", at + block) + 1 or len(text)
                    if xxhash.xxh64_intdigest(text[at:end], (key + at) % (1 << 64)) % every == 0:
                        langs.append(lang)
                        chosen.append(text[at:end])
                    at = end
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(chosen, pa.binary())], ["lang", "text"])

    return docs.mapInArrow(read, "lang string, text binary")


def propose(sample: DataFrame, max_words: int, least: int) -> Bitmap:
    """Mine a sample level by level: what is frequent there at the lowered threshold."""
    found = Bitmap.empty()
    # phrases of the full length are part of no other
    for n in range(1, max_words):
        counts = count_hashes(sample, n, found, levels=(n,))
        frequent = counts.groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        found = found | bitmap_of(frequent)
    return found


def known_words(sample: DataFrame, proposed: Bitmap, least: int) -> Known:
    """The proposed words or, where they are too many, about the most frequent of them."""
    counts = count_phrases(sample, 1, proposed).where("n_words = 1")
    counts = counts.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    counts = stored(counts, "phrases-known")
    n_words = counts.count()
    if n_words > MOST_KNOWN:
        # a sort with a limit would have every task send that many to the driver
        share = 1 - MOST_KNOWN / n_words
        counts = counts.where(F.col("n") >= counts.agg(F.percentile_approx("n", share)).first()[0])
    most = counts.select("lang", "phrase").limit(MOST_KNOWN).toPandas()
    return Known([(lang, word.encode()) for lang, word in most.itertuples(index=False)])


def frequent_phrases(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
    max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, every: int = SAMPLE_EVERY,
) -> tuple[DataFrame, DataFrame]:
    """(lang, n_words, phrase, n) of every phrase that is frequent, and (lang, words)."""
    if not 1 <= max_words < 1 << _LEVEL_BITS:
        raise ValueError(f"phrases have from 1 to {(1 << _LEVEL_BITS) - 1} words")
    rows = lean(docs).select(
        F.coalesce(F.col(lang), F.lit(UNKNOWN_LANG)).alias("lang"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"),
        F.xxhash64(F.col(doc_id)).alias("doc_key"),
    )
    sample = stored(sample_blocks(rows, every), "phrases-sample")
    least = max(2, int(CAUTION * min_count / every))
    proposed, before = propose(sample, max_words, least), None
    known = known_words(sample, proposed, least)
    texts, frequent, counts = rows.drop("doc_key"), Bitmap.empty(), None

    def enough(keyed: DataFrame, purpose: str) -> DataFrame:
        sums = keyed.groupBy("key").agg(F.sum("n").alias("n"))
        is_total = F.substring("key", 1, 1) == F.lit(_TOTAL)
        return stored(told(sums.where((F.col("n") >= min_count) | is_total), known), purpose)

    level = F.col("hash").bitwiseAND(F.lit((1 << _LEVEL_BITS) - 1))
    for turn in range(max_words):
        keyed = count_hashes(
            texts, max_words, proposed, before, often=max(2, int(min_count / OFTEN)), as_much=min_count, known=known
        )
        found = enough(keyed, f"phrases-pass-{turn}")
        counts = found if counts is None else counts.union(found)
        hashes = found.where("hash is not null")
        frequent = frequent | bitmap_of(hashes)
        # frequent, but not proposed: what is made of them has not been counted
        parts = bitmap_of(hashes.where(level < max_words))
        missed = parts.without(proposed)
        if not missed.size():
            break
        if turn == 0 and FEW * missed.size() <= proposed.size():
            around = count_hashes(texts, max_words, frequent, missed=missed, known=known)
            counts = counts.union(enough(around, "phrases-around"))
            break
        before, proposed = proposed, proposed | parts
    words = counts.where("n_words = 0").select("lang", F.col("n").alias("words"))
    return counts.where("n_words > 0 and phrase is not null").drop("hash"), words


def _part(first: str, last: str):
    """The words of ``list`` from one place to another, as a phrase."""
    return F.expr(f"array_join(slice(list, {first}, {last} - {first} + 1), ' ')")


def scored_phrases(counts: DataFrame, words: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n and score of the phrases of two words and more."""
    sizes = counts.where("n_words > 1").groupBy("lang").agg(F.count("*").alias("key_rows"))
    facts = stored(sizes.join(words, "lang"), "phrases-languages")
    named = counts.where("n_words > 1").withColumn("list", F.split("phrase", " "))
    parts = named.select(
        "lang", "phrase", "n_words", F.col("n").alias("a"), "list",
        F.explode(F.expr("sequence(1, n_words - 1)")).alias("k"),
    )
    sides = [
        F.struct(F.lit(0).alias("side"), _part("1", "k").alias("part")),
        F.struct(F.lit(1).alias("side"), _part("k + 1", "n_words").alias("part")),
    ]
    parts = parts.select("lang", "phrase", "n_words", "a", "k", F.inline(F.array(*sides)))
    parts = stored(parts, "phrases-parts")
    uses = parts.groupBy("lang", "part").agg(F.count("*").alias("key_rows"))
    known = counts.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    met = attach(parts, stored(uses.join(known, ["lang", "part"]), "phrases-uses"), ["lang", "part"])
    # at most two parts for each cut, and a cut for each word but one
    cut = F.struct((2 * F.col("k") + F.col("side")).alias("key"), F.col("f").alias("value"))
    one = met.groupBy("lang", "phrase", "n_words", "a").agg(F.map_from_entries(F.collect_list(cut)).alias("f"))
    one = attach(stored(one, "phrases-cuts"), facts, ["lang"])
    exact = "cast({} as decimal(19,0))"
    ratio = f"""transform(sequence(1, n_words - 1), k -> struct(
        (cast(1000 as decimal(4,0)) * ({exact.format('a')} * {exact.format('words')}))
            div ({exact.format('f[2 * k]')} * {exact.format('f[2 * k + 1]')}) as score,
        k as k, f[2 * k] as l, f[2 * k + 1] as r))"""
    best = one.withColumn("best", F.array_min(F.expr(ratio)))
    return best.select(
        "lang", "phrase", "n_words", "a", "best.l", "best.r", F.col("words").alias("n"), "best.score"
    )


def longest_only(phrases: DataFrame, share: int = SHARE) -> DataFrame:
    """Without the phrases inside a longer one that has ``share`` hundredths of their count."""
    longer = phrases.where("n_words > 2").withColumn("list", F.split("phrase", " "))
    # all runs of two words and more but the phrase itself; no more than 9 for 5 words
    inner = longer.select(
        "lang", "a", "n_words", "list", F.explode(F.expr("sequence(1, n_words - 1)")).alias("i")
    ).select(
        "lang", "a", "n_words", "list", "i", F.explode(F.expr("sequence(i + 1, n_words)")).alias("j")
    ).where("j - i + 1 < n_words")
    inner = inner.select("lang", _part("i", "j").alias("phrase"), "a")
    most = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer_a"))
    joined = phrases.join(most, ["lang", "phrase"], "left")
    kept = F.col("longer_a").isNull() | (F.col("longer_a") * 100 < F.col("a") * share)
    return joined.where(kept).drop("longer_a")


def collocations(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", *,
    max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, top: int = TOP, share: int = SHARE,
    every: int = SAMPLE_EVERY,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the best phrases of every language."""
    with freeing_shuffles(docs.sparkSession):
        counts, words = frequent_phrases(docs, doc_id, text, lang, max_words, min_count, every)
        phrases = stored(scored_phrases(counts, words), "phrases-scored")
    kept = longest_only(phrases, share)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first within parts of a language, so that none is ranked by one task as a whole
    kept = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = Window.partitionBy("lang", "salt").orderBy(*order)
    kept = kept.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ranked.where(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score"
    )


ORACLE = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text,
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
lists AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS words FROM pieces),
runs AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM lists),
grams AS (SELECT lang, array_to_string(words[i : i + k - 1], ' ') AS phrase, k
    FROM runs, range(1, 6) AS sizes(k) WHERE i + k - 1 <= len(words)),
totals AS (SELECT lang, count(*)::HUGEINT AS n FROM grams WHERE k = 1 GROUP BY lang),
counts AS (SELECT lang, phrase, k, count(*)::HUGEINT AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
candidates AS (SELECT *, string_split(phrase, ' ') AS words FROM counts WHERE k > 1),
cuts AS (SELECT lang, phrase, k, f, words, unnest(range(1, k)) AS cut FROM candidates),
scored AS (SELECT cuts.lang, cuts.phrase, cuts.f AS a, cut, h.f AS l, t.f AS r, n,
        (1000 * cuts.f * n) // (h.f * t.f) AS score
    FROM cuts JOIN totals USING (lang)
    JOIN counts h ON h.lang = cuts.lang AND h.phrase = array_to_string(words[1 : cut], ' ')
    JOIN counts t ON t.lang = cuts.lang AND t.phrase = array_to_string(words[cut + 1 : cuts.k], ' ')),
best AS (SELECT * FROM scored
    QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
starts AS (SELECT lang, phrase, k, f, words, unnest(range(1, k)) AS i FROM candidates WHERE k > 2),
inner_runs AS (SELECT lang, array_to_string(words[i : j], ' ') AS phrase, f
    FROM starts, range(2, 6) AS ends(j) WHERE j > i AND j <= k AND j - i + 1 < k),
longer AS (SELECT lang, phrase, max(f) AS longer_f FROM inner_runs GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN longer USING (lang, phrase)
    WHERE longer_f IS NULL OR 100 * longer_f < 100 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r,
    n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
