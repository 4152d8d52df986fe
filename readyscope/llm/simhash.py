"""Near-duplicates by SimHash fingerprints and multi-index hashing.

A fingerprint is cut into as many segments as make the Hamming ball of each small:
two fingerprints that differ in at most ``r`` bits differ in at most ``r // m`` bits
in one of ``m`` segments. Every segment has a table of the fingerprints by its value;
each fingerprint looks up all values in the ball around its own, and what it meets is
verified over all bits. With 64 bits, r = 3 and m = 2 that is 33 lookups a segment,
each into a table of four billion values.

Copies share a fingerprint and are collapsed before, so links run between distinct
fingerprints only. Should very many distinct fingerprints share one segment value, the
pairs among them could grow with the square; such buckets are linked instead through
balls in the other bits (see ``_crowded_links``), with work in proportion to their
members and no link lost.

Defined results: a null text counts as empty; a text without words has fingerprint zero
and is linked like any other; rows that share a document id share a component; a null
id never names a component, so a component of such rows alone has a null id.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readyscope.llm.common import sized, stored, whole

SHINGLE_WORDS = 3
SEED = 42
MAX_DISTANCE = 3
CROWDED = 1000

BITS, SEGMENTS = 64, 2
WIDTH = BITS // SEGMENTS
NO_ID = (1 << 63) - 1
_SLICE = 1 << 16


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """SimHash of the word shingles of a text, as a signed 64-bit integer."""
    # on bytes, lower() and split() touch A-Z and the ASCII white space only
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle_words:
        shingles = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle_words)), strict=False))
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), shingles), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _SLICE):
        octets = hashes[at : at + _SLICE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def with_fingerprint(
    docs: DataFrame,
    text: str = "text",
    column: str = "fingerprint",
    shingle_words: int = SHINGLE_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """Add the fingerprint of a text column, as a long."""

    @F.pandas_udf("long")
    def of_texts(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fingerprint(t, shingle_words, seed)).astype("int64")

    return docs.withColumn(column, of_texts(whole(text)))


def _segment(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, WIDTH * k).bitwiseAND(F.lit((1 << WIDTH) - 1))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _table(nodes: DataFrame) -> DataFrame:
    """Every fingerprint under its value in each segment."""
    entries = [F.struct(F.lit(k).alias("seg"), _segment(F.col("fp"), k).alias("value"))
               for k in range(SEGMENTS)]
    return nodes.select("fp", F.inline(F.array(*entries)))


def _ball(entries: DataFrame, radius: int) -> DataFrame:
    """Every entry under all values within ``radius`` bits of its own."""
    flips = [sum(1 << b for b in bits)
             for n in range(radius + 1) for bits in combinations(range(WIDTH), n)]
    flip = F.explode(F.array(*[F.lit(f).cast("long") for f in flips]))
    probes = entries.select("fp", "seg", "value", flip.alias("flip"))
    return probes.select(
        "fp", "seg", F.col("value").bitwiseXOR(F.col("flip")).alias("value"),
        F.bit_count("flip").alias("spent"),
    )


def near_links(nodes: DataFrame, max_distance: int = MAX_DISTANCE, crowded: int = CROWDED):
    """Links between distinct fingerprints: every pair within the distance, except that
    those of a crowded bucket are linked through one of their number instead.

    ``nodes`` has one row per fingerprint in ``fp`` and should be a stored table.
    """
    table = _table(nodes)
    counts = table.groupBy("seg", "value").count().where(F.col("count") > crowded)
    full = stored(counts.select("seg", "value"), "simhash-crowded")
    probes = _ball(table, max_distance // SEGMENTS)
    if full.isEmpty():
        quiet = table
    else:
        quiet = table.join(full, ["seg", "value"], "left_anti")
    # Spark sizes exploded rows as if they had not been, and would broadcast the lookups
    a, b = probes.withColumnRenamed("fp", "a").hint("merge"), quiet.withColumnRenamed("fp", "b")
    pairs = a.join(b, ["seg", "value"]).where(
        (F.col("a") != F.col("b"))
        & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance)
    )
    links = pairs.select("a", "b")
    if full.isEmpty():
        return links
    return links.unionByName(_crowded_links(table, probes, full, max_distance))


def _crowded_links(table, probes, full, max_distance):
    """Links into crowded buckets, linear in their members.

    Whoever looks up a bucket has spent some bits on the segment and has ``left`` bits
    for the rest of the fingerprint. Two fingerprints differ in at most ``left`` bits of
    the rest exactly if they are equal there with some ``left`` bits masked. So members
    and lookups meet under their masked rest, and all are linked to the least member:
    each of them is within the distance of it. Lookups that meet no member link nothing.
    """
    links = None
    members = table.join(full, ["seg", "value"]).withColumn("member", F.lit(True))
    for spent in range(max_distance // SEGMENTS + 1):
        left = max_distance - spent
        seekers = probes.where(F.col("spent") == spent).join(full, ["seg", "value"])
        seekers = seekers.select("fp", "seg", "value", F.lit(False).alias("member"))
        entries = members.unionByName(seekers) if spent else members
        for seg in range(SEGMENTS):
            own = ((1 << WIDTH) - 1) << (WIDTH * seg)
            others = [b for b in range(BITS) if not own >> b & 1]
            masks = [
                _signed(~(own | sum(1 << b for b in bits)) & ((1 << 64) - 1))
                for bits in combinations(others, left)
            ]
            masked = (
                entries.where(F.col("seg") == seg)
                .withColumn("mask", F.explode(F.lit(masks)))
                .withColumn("rest", F.col("fp").bitwiseAND(F.col("mask")))
            )
            key = ["value", "mask", "rest"]
            least = masked.groupBy(*key).agg(
                F.min(F.when(F.col("member"), F.col("fp"))).alias("b"), F.count("*").alias("n")
            )
            met = masked.hint("merge").join(least.where("n > 1 AND b IS NOT NULL"), key)
            found = met.where(F.col("fp") != F.col("b")).select(F.col("fp").alias("a"), "b")
            links = found if links is None else links.unionByName(found)
    return links.distinct()


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """The least document id reachable from each fingerprint.

    ``nodes`` has fp and id (the least of its documents), one row per fingerprint, and
    should be a stored table. Every round, each linked fingerprint takes the least label
    among its neighbours and then the label of the fingerprint that its label came from,
    which shortens long chains. Labels are stored each round; no group is ever gathered.
    """
    # a pair is found once in each direction or in one only, so both are made sure of
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stored(both.distinct(), "simhash-links")
    touched = edges.select(F.col("a").alias("fp")).distinct()
    own = F.struct(F.coalesce("id", F.lit(NO_ID)).alias("id"), F.col("fp"))
    labels = stored(nodes.join(touched, "fp").select("fp", own.alias("label")), "simhash-labels")
    n = labels.count()
    while True:
        sent = edges.join(sized(labels, n), edges["b"] == labels["fp"]).select(
            F.col("a").alias("fp"), "label", F.lit(None).cast(labels.schema["label"].dataType).alias("old")
        )
        kept = labels.withColumn("old", F.col("label"))
        nearest = sent.unionByName(kept).groupBy("fp").agg(
            F.min("label").alias("label"), F.max("old").alias("old")
        )
        nearest = stored(nearest, "simhash-labels")
        source = nearest.select(F.col("fp").alias("via"), F.col("label").alias("further"))
        jumped = nearest.join(sized(source, n), F.col("label.fp") == F.col("via"))
        jumped = jumped.select("fp", F.least("label", "further").alias("label"), "old")
        labels = stored(jumped, "simhash-labels")
        if labels.where(F.col("label") != F.col("old")).isEmpty():
            break
        labels = labels.drop("old")
    named = labels.select("fp", F.col("label.id").alias("root"))
    found = nodes.join(sized(named, n), "fp", "left")
    root = F.coalesce("root", "id")
    return found.select("fp", F.when(root != NO_ID, root).alias("component_id"))


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    max_distance: int = MAX_DISTANCE,
    seed: int = SEED,
    crowded: int = CROWDED,
) -> DataFrame:
    """doc_id, fingerprint (long) and component_id of every document."""
    marked = with_fingerprint(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")),
        "text", "fingerprint", shingle_words, seed,
    )
    marked = stored(marked.drop("text"), "simhash-fingerprints")
    nodes = marked.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("id"))
    nodes = stored(nodes, "simhash-nodes")
    links = near_links(nodes, max_distance, crowded)
    roots = stored(components(nodes, links), "simhash-roots")
    # two plain scans, so that a fingerprint of very many copies can be split at run time
    return marked.join(sized(roots, roots.count()), marked["fingerprint"] == roots["fp"]).drop("fp")


def first_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay: of each component the one with the least id.

    Rows that repeat that id are one document, of which one row stays. Rows without an
    id cannot be told apart and stay.
    """
    found = near_duplicates(docs, **options)
    gone = found.where(F.col("doc_id") != F.col("component_id"))
    spare = found.groupBy("doc_id").count().where("count > 1").select("doc_id")
    kept = docs.join(gone.select("doc_id").distinct(), "doc_id", "left_anti")
    once = kept.join(spare, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(spare, "doc_id", "left_anti").unionByName(once)
