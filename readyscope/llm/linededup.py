"""Repeated passages, found by winnowing over line hashes and cut where they come again.

A line ends at a line break or at the end of a sentence, so that a passage pasted into a
paragraph is made of whole lines too. A window is the least number of lines from some
line on, or up to some line, that have ``WINDOW_WORDS`` words. From each window the line of least hash is
selected as its fingerprint (the last of several). Equal windows select the same line, so
every repeated run of that many words holds a fingerprint that is selected in both places,
and no run of that length can be missed.

Positions are joined by fingerprint: only windows around a fingerprint that occurs more
than once can be repeated. From each such position the match is extended both ways, by
the windows that hold it, as far as they are the same in both places: a window is a
repetition if it occurs earlier, and overlapping repetitions make one run. As windows go
on from every line and back from every line, those within a run of that many words hold
all of its lines, the last ones too. Earlier is by document id, then by place. The first occurrence stays; the runs that come later are cut.
A repetition that overlaps its own first occurrence is cut only behind that.

Only selected lines are shuffled, the texts once, to be cut. A fingerprint or passage of
very many documents is joined by broadcast (see ``common.attach``).

Defined results: a null text stays null; empty texts and texts of fewer words stay as
they are; equal lines are those with equal words, whatever the white space between; rows
that repeat id and text are one document and cut alike; rows without an id come last.
Hashes: 64 bits of the fingerprint and 64 of the window decide that windows are equal.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readyscope.llm.common import attach, columns_of, stored, unused, whole

WINDOW_WORDS = 25
_END = re.compile(r"[.!?]\s+|\n\s*")
_BASE = np.uint64(0x9E3779B97F4A7C15)
NO_ID = (1 << 63) - 1
_SLICE = 2000  # texts at a time, which bounds what a worker holds
WINDOWS = "array<struct<key:bigint,start:int,end:int>>"


def lines_of(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, words) of every line with words; an end takes in the white space after."""
    start = 0
    for end in [m.end() for m in _END.finditer(text)] + [len(text)]:
        if words := text[start:end].split():
            yield start, end, words
        start = end


def _hash(words: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(words))


class _Lines:
    """The lines of several texts, one after the other."""

    def __init__(self, texts: list[str]):
        hashes, words, starts, ends, counts = [], [], [], [], []
        for text in texts:
            before = len(hashes)
            for start, end, own in lines_of(text):
                hashes.append(_hash(own))
                words.append(len(own))
                starts.append(start)
                ends.append(end)
            counts.append(len(hashes) - before)
        self.hashes = np.array(hashes, np.uint64)
        self.starts, self.ends = np.array(starts, np.int32), np.array(ends, np.int32)
        self.total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
        self.text = np.repeat(np.arange(len(texts)), counts)
        self.limit = np.repeat(np.cumsum(counts), counts)  # the end of each line's text
        self.begin = self.limit - np.repeat(counts, counts)


@np.errstate(over="ignore")
def windows(lines: _Lines, window_words: int):
    """(first line, last line + 1, selected line, key) of every window, forward from each
    line and back from each, in order. Neither end ever goes back, so selected lines do not."""
    n = len(lines.hashes)
    line = np.arange(n)
    stop = np.searchsorted(lines.total, lines.total[:-1] + window_words, "left")
    first = np.searchsorted(lines.total, lines.total[1:] - window_words, "right") - 1
    ahead, back = stop <= lines.limit, first >= lines.begin
    forward = line[ahead] * (n + 1) + stop[ahead]
    backward = first[back] * (n + 1) + line[back] + 1
    first, stop = np.divmod(np.unique(np.concatenate([forward, backward])), n + 1)
    least, key = lines.hashes[first], lines.hashes[first].copy()
    selected, factor = first.copy(), _BASE  # 64-bit arithmetic wraps
    # one step per line of the longest window, over all windows at once
    for k in range(1, int((stop - first).max(initial=0))):
        inside = np.flatnonzero(first + k < stop)
        here = lines.hashes[first[inside] + k]
        key[inside] += here * factor
        factor = np.multiply(factor, _BASE)
        lower = here <= least[inside]
        least[inside[lower]] = here[lower]
        selected[inside[lower]] = first[inside[lower]] + k
    key ^= key >> np.uint64(29)
    return first, stop, selected, key * _BASE + (stop - first).astype(np.uint64)


def fingerprints(docs: DataFrame, window_words: int = WINDOW_WORDS) -> DataFrame:
    """The selected lines of (doc_id, tag, text): fp, doc_id, tag and the windows of each."""
    schema = f"fp long, doc_id long, tag int, windows {WINDOWS}"

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = (b.slice(at, _SLICE) for b in batches for at in range(0, b.num_rows, _SLICE))
        for batch in slices:
            lines = _Lines(batch.column("text").to_pylist())
            first, stop, selected, key = windows(lines, window_words)
            if not len(first):
                continue
            # windows come in order, and so do the lines they select
            begins = np.flatnonzero(np.diff(selected, prepend=-1))
            chosen = selected[begins]
            inner = pa.StructArray.from_arrays(
                [
                    pa.array(key.view(np.int64)),
                    pa.array(lines.starts[first]),
                    pa.array(lines.ends[stop - 1]),
                ],
                ["key", "start", "end"],
            )
            offsets = pa.array(np.append(begins, len(first)).astype(np.int32))
            rows = pa.array(lines.text[chosen])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(lines.hashes[chosen].view(np.int64)),
                    batch.column("doc_id").take(rows),
                    batch.column("tag").take(rows),
                    pa.ListArray.from_arrays(offsets, inner),
                ],
                ["fp", "doc_id", "tag", "windows"],
            )

    return docs.mapInArrow(select, schema)


def repeated_spans(docs: DataFrame, window_words: int = WINDOW_WORDS) -> DataFrame:
    """doc_id, tag, start and end of the windows of (doc_id, tag, text) that come again."""
    marks = stored(fingerprints(docs, window_words), "lines-fingerprints")
    counts = marks.groupBy("fp").agg(F.count("*").alias("key_rows")).where("key_rows > 1")
    met = attach(marks, stored(counts, "lines-repeated"), ["fp"])
    found = met.select("fp", "doc_id", "tag", F.inline("windows"))
    found = stored(found, "lines-windows")
    key = ["fp", "key"]
    place = F.struct(F.coalesce("doc_id", F.lit(NO_ID)), "tag", "start", "end")
    firsts = found.groupBy(*key).agg(
        F.min(place).alias("first"), F.count("*").alias("key_rows")
    )
    firsts = stored(
        firsts.where("key_rows > 1").select(
            *key, "key_rows",
            F.col("first.col1").alias("first_id"), F.col("first.tag").alias("first_tag"),
            F.col("first.start").alias("first_start"), F.col("first.end").alias("first_end"),
        ),
        "lines-firsts",
    )
    same = (F.coalesce("doc_id", F.lit(NO_ID)) == F.col("first_id")) & (
        F.col("tag") == F.col("first_tag")
    )
    again = attach(found, firsts, key)
    start = F.when(same, F.greatest("start", "first_end")).otherwise(F.col("start"))
    # the first occurrence itself has nothing behind its own end
    return again.select("doc_id", "tag", start.alias("start"), "end").where("start < end")


def without_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window_words: int = WINDOW_WORDS
) -> DataFrame:
    """All columns, the text without its repeated runs, and ``cut_spans``: what was cut of
    the original, as an array of start and end (null where nothing was)."""
    docs = docs.drop("cut_spans")
    tag = F.hash(whole(text))
    named = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), tag.alias("tag"), whole(text).alias("text")
    )
    spans = repeated_spans(named, window_words)
    cuts = spans.groupBy("doc_id", "tag").agg(
        F.collect_set(F.struct("start", "end")).alias("cut_spans")
    )
    own = {c: unused(docs, f"_{c}") for c in ("id", "tag", "own", "cut")}
    cuts = cuts.select(
        F.col("doc_id").alias(own["id"]),
        F.col("tag").alias(own["tag"]),
        F.sort_array("cut_spans").alias("cut_spans"),
    )

    @F.pandas_udf("text string, cut_spans array<struct<start:int,end:int>>")
    def cut(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        rows = [
            (None, None) if f is None else _cut(t, f) for t, f in zip(texts, found, strict=True)
        ]
        return pd.DataFrame(rows, columns=["text", "cut_spans"])

    same = F.col(doc_id).cast("long").eqNullSafe(F.col(own["id"]))
    same &= F.col(own["own"]) == F.col(own["tag"])
    joined = docs.withColumn(own["own"], tag).join(cuts, same, "left")
    # only texts that are cut go to the workers
    touched = F.when(F.col("cut_spans").isNotNull(), F.col(text))
    done = F.col(own["cut"])
    edited = joined.withColumn(own["cut"], cut(touched, F.col("cut_spans")))
    edited = edited.withColumn(text, F.coalesce(done["text"], F.col(text)))
    return edited.select(*columns_of(docs), done["cut_spans"].alias("cut_spans"))


def _cut(text: str, spans) -> tuple[str, list[tuple[int, int]]]:
    """The text without the spans, and the spans with those that meet merged."""
    merged: list[list[int]] = []
    for span in spans:
        if merged and span["start"] <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], span["end"])
        else:
            merged.append([span["start"], span["end"]])
    kept, at = [], 0
    for start, end in merged:
        kept.append(text[at:start])
        at = end
    return "".join([*kept, text[at:]]), [tuple(m) for m in merged]


def drop_repeats(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents without repeated runs; those of which nothing is left go."""
    hidden = {"cut_spans": unused(docs, "_cut_spans")} if "cut_spans" in docs.columns else {}
    cut = without_repeats(docs.withColumnsRenamed(hidden), text=text, **options)
    emptied = F.col("cut_spans").isNotNull() & ~F.col(text).rlike(r"\S")
    kept = cut.where(~emptied).drop("cut_spans")
    return kept.withColumnsRenamed({b: a for a, b in hidden.items()}).select(*columns_of(docs))
