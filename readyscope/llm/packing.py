"""Packing tokenised documents into sequences by bin completion.

Items of equal length are interchangeable, so a packing is a list of fillings, each with
the number of sequences filled that way. It is found on the table of item counts by
length, which has at most as many rows as a sequence has tokens, however large the
corpus; the items themselves are never gathered.

The search is branch-and-bound. The largest open item must go somewhere, so each node
completes a sequence around it. The fillings tried are those of least waste that no other
filling dominates (none that a larger single item in place of one or two of theirs would
fill as well or better). A branch is cut
when its waste so far exceeds what a better packing than the incumbent may waste in all.
How often a filling is used is a branch too: as often as the counts allow, half as often,
and so on down to once. The first incumbent packs best-fit: into each sequence the largest
item that fits. Where it misses the simple bounds, the fractional packing (column
generation over fillings) gives a sharper bound, and its whole parts, with the rest packed
by bin completion, another incumbent. The search ends at a packing that meets the bound,
which nothing can beat, or with the best packing that its effort finds; the effort grows
with the number of lengths. ``gap`` tells the sequences beyond the proved bound. A node
holds no more than its filling, so the search needs little memory at any depth.

Placing the items is relational: each gets its rank among those of its length, and the
plan says which ranks go to which sequence and offset. Ranks are counted within salted
groups of a length, so that a very common length is no task of its own.

Defined results: a null text counts as empty and is one end token; repeated rows are
items of their own; rows with the same id and piece are told apart by their checksum.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readyscope.llm.bpe import byte_characters
from readyscope.llm.common import stored, whole

CAPACITY = 2048
END_ID = 0
# Of a search: nodes for each length, and fillings that the fractional packing may try for
# each length, as long as these stay below so many cells of the knapsack
NODES_PER_LENGTH = 2
ROUNDS_PER_LENGTH = 8
KNAPSACK_CELLS = 1_500_000_000
# Closer to the bound than this share, the search alone tries to better a packing
NARROW = 0.002
_KEPT_CHOICES = 16  # nodes whose choices are not made anew on the way back
REMEMBERED_CHUNKS = 300_000
LONGEST_CHUNK = 256

Filling = tuple[tuple[int, int], ...]  # (length, how many of it), longest first
Plan = list[tuple[Filling, int]]  # with the number of sequences


# --- tokens -----------------------------------------------------------------------------


class ChunkedTokenizer:
    """Token ids of whole texts, remembered by chunk.

    Byte-level pre-tokens never span a blank that follows other text, so a text may be
    cut before each such blank and its chunks encoded by themselves. Chunks of Latin text
    go to the faster library, which holds the same vocabulary as ranks.
    """

    _BLANK_AFTER_SPACE = re.compile(r"\s ")
    _CUT = re.compile(r"(?<=\S)(?= )")
    _LATIN = re.compile(r"[\x00-\x7e\xa1-ſ]*")

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocab = self.library.get_vocab(with_added_tokens=False)
        octet = {character: b for b, character in enumerate(byte_characters())}
        ranks = {bytes(octet[c] for c in token): i for token, i in vocab.items()}
        # Fixed value: the pattern of byte-level pre-tokens
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding(
            "chunks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
        )
        added = self.library.get_added_tokens_decoder().values()
        self.special = [token.content for token in added]
        self.known: dict[str, bytes] = {}

    def _chunks(self, text: str) -> list[str]:
        if self._BLANK_AFTER_SPACE.search(text):
            return self._CUT.split(text)
        first, *rest = text.split(" ")
        return [first, *[" " + chunk for chunk in rest]]

    def _encoded(self, chunk: str) -> bytes:
        if len(chunk) > LONGEST_CHUNK or not (chunk.isascii() or self._LATIN.fullmatch(chunk)):
            return _octets(self.library.encode(chunk, add_special_tokens=False).ids)
        if chunk[-1:] in (",", ".") and chunk[-2:-1].isalpha():
            # a word and its punctuation are pre-tokens of their own
            return self._chunk(chunk[:-1]) + self._chunk(chunk[-1])
        return _octets(self.fast.encode_ordinary(chunk))

    def _chunk(self, chunk: str) -> bytes:
        found = self.known.get(chunk)
        if found is None:
            found = self._encoded(chunk)
            if len(chunk) <= LONGEST_CHUNK:
                if len(self.known) >= REMEMBERED_CHUNKS:
                    self.known.clear()  # common chunks soon return
                self.known[chunk] = found
        return found

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if any(token in text for token in self.special):
            return _octets(self.library.encode(text, add_special_tokens=False).ids)
        known, own = self.known.get, self._chunk
        return b"".join([known(chunk) or own(chunk) for chunk in self._chunks(text)])


def _octets(ids: list[int]) -> bytes:
    return np.fromiter(ids, "<u4", len(ids)).tobytes()


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ChunkedTokenizer:
    return ChunkedTokenizer(path)


def pieces_of(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of a document: all full but perhaps the first."""
    first = n if n <= capacity else n % capacity or capacity
    yield 0, first
    for start in range(first, n, capacity):
        yield start, capacity


def token_pieces(
    docs: DataFrame,
    path: str,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids of every piece."""
    wanted = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    key_type = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {key_type}, piece int, start long, length long, ids_crc32 long"
    schema += ", ids array<int>" * with_ids
    end = np.uint32(end_id).tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = tokenizer(path)
        try:
            for batch in batches:
                yield pieces_in(own, batch)
        finally:
            own.known.clear()  # an idle worker holds no memory

    def pieces_in(own: ChunkedTokenizer, batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for key, one in zip(batch["doc_id"], batch["text"], strict=True):
            octets = own.encode(one) + end
            for piece, (start, length) in enumerate(pieces_of(len(octets) // 4, capacity)):
                part = octets[4 * start : 4 * (start + length)]
                row = (key, piece, start, length, zlib.crc32(part))
                if with_ids:
                    row += (np.frombuffer(part, "<u4").astype(np.int32),)
                out.append(row)
        found = pd.DataFrame(out, columns=wanted)
        # a nullable id column arrives as float or object; back to whole numbers
        found["doc_id"] = found["doc_id"].astype(batch["doc_id"].convert_dtypes().dtype)
        return found

    return docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text")).mapInPandas(
        cut, schema
    )


# --- the plan ---------------------------------------------------------------------------


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: by volume, and by items that exclude each other.

    For a threshold t, items above capacity - t take a sequence each, as do those above
    half of it; what t or more is left beside the latter can hold middle-sized items only.
    """
    best = -(-sum(length * n for length, n in counts.items()) // capacity)
    for t in [0, *[x for x in counts if x <= capacity // 2]]:
        alone = sum(n for x, n in counts.items() if x > capacity - t)
        halves = {x: n for x, n in counts.items() if capacity // 2 < x <= capacity - t}
        middle = sum(x * n for x, n in counts.items() if t <= x <= capacity // 2)
        room = sum((capacity - x) * n for x, n in halves.items())
        rest = max(0, -(-(middle - room) // capacity))
        best = max(best, alone + sum(halves.values()) + rest)
    return best


def share_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences by rounded shares: for each k, an item counts k-ths of a sequence, as many
    as (k + 1)-ths it fills, or its exact size where those come out even."""
    best = 0
    for k in range(1, 101):
        total = 0  # in units of 1 / (k * capacity)
        for length, n in counts.items():
            whole_parts, rest = divmod((k + 1) * length, capacity)
            total += n * (whole_parts * capacity if rest else k * length)
        best = max(best, -(-total // (k * capacity)))
    return best


def _fullest(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For every room, the greatest value of a filling with any number of copies, and the
    place of a length in it (-1: the same as with one token less)."""
    best, chosen = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    # lengths ascend, so those that fit are the first ones
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right").tolist()
    for room in range(int(lengths[0]), capacity + 1):
        n = fits[room]
        reached = best[room - lengths[:n]] + values[:n]
        at = reached.argmax()
        if reached[at] > best[room - 1]:
            best[room], chosen[room] = reached[at], at
        else:
            best[room] = best[room - 1]
    return best, chosen


def _filling(chosen: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Copies of each length in the fullest filling."""
    copies, room = np.zeros(len(lengths)), capacity
    while room > 0:
        if chosen[room] < 0:
            room -= 1
        else:
            copies[chosen[room]] += 1
            room -= int(lengths[chosen[room]])
    return copies


def slope_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences by worths that rise with a slope around 1 / (k + 1) and end at 1 / k.

    Whatever items are worth, a packing needs their worth by that of the fullest filling.
    """
    lengths = np.array(sorted(counts))
    wanted = np.array([counts[x] for x in lengths.tolist()], np.float64)
    best = 0
    for k in (1, 2, 3, 4, 5):
        for slope in (1, 1.25, 1.5, 2, 3, 5, 9):
            worth = np.clip(1 / (k + 1) + slope * (lengths / capacity - 1 / (k + 1)), 0, 1 / k)
            worth = np.where(lengths * 2 > capacity, np.maximum(worth, 1 - worth.max()), worth)
            most = _fullest(worth, lengths, capacity)[0][capacity]
            if most > 0:
                best = max(best, math.ceil(float(wanted @ worth) / most * (1 - 1e-9) - 1e-6))
    return best


def fractional(counts: dict[int, int], capacity: int) -> tuple[int, list[tuple[np.ndarray, float]]]:
    """A proved bound and the fillings (copies of each length, ascending) of a packing that
    may use fillings in part, with how often each is used: column generation."""
    lengths = np.array(sorted(counts))
    wanted = np.array([counts[x] for x in lengths.tolist()], np.float64)
    n = len(lengths)
    copies = np.maximum(1, capacity // lengths)
    fillings = [np.eye(n)[i] * copies[i] for i in range(n)]
    used, inverse = wanted / copies, np.diag(1.0 / copies)
    bound = 0
    for _ in range(min(ROUNDS_PER_LENGTH * n, KNAPSACK_CELLS // (capacity * n))):
        worth = inverse.sum(axis=0)  # of an item of each length
        best, chosen = _fullest(worth, lengths, capacity)
        # no filling is worth more than the fullest, so every packing needs this many
        bound = max(bound, math.ceil(used.sum() / max(1.0, best[capacity]) - 1e-6))
        if best[capacity] <= 1 + 1e-9 or bound >= math.ceil(used.sum() - 1e-6):
            break
        filling = _filling(chosen, lengths, capacity)
        change = inverse @ filling
        growing = change > 1e-12
        ratios = np.where(growing, used / np.where(growing, change, 1.0), np.inf)
        out = int(ratios.argmin())
        step = ratios[out]
        used = np.maximum(used - step * change, 0.0)
        used[out] = step
        row = inverse[out] / change[out]
        change[out] = 0.0
        inverse -= np.outer(change, row)
        inverse[out] = row
        fillings[out] = filling
    return bound, list(zip(fillings, used.tolist(), strict=True))


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Fill each sequence with the largest item that fits, again and again."""
    left, plan = dict(counts), []
    while left:
        room, filling = capacity, []
        for length in sorted(left, reverse=True):
            n = min(left[length], room // length)
            if n:
                filling.append((length, n))
                room -= n * length
        plan.append(_use(left, tuple(filling)))
    return plan


def _use(left: dict[int, int], filling: Filling, times: int | None = None) -> tuple[Filling, int]:
    """Take a filling so many times, or as often as the counts allow."""
    if times is None:
        times = min(left[length] // n for length, n in filling)
    for length, n in filling:
        left[length] -= n * times
        if not left[length]:
            del left[length]
    return filling, times


def _sums(counts: dict[int, int], lengths: list[int], room: int) -> list[int]:
    """Bit sets of the totals up to ``room`` that lengths[i:] can make, for each i."""
    limit, reach = (1 << (room + 1)) - 1, [1]
    for length in reversed(lengths):
        made, n, step = reach[-1], min(counts[length], room // length), 1
        while n > 0:  # doubling steps cover every number of copies up to n
            take = min(step, n)
            made |= (made << (length * take)) & limit
            n, step = n - take, step * 2
        reach.append(made)
    return reach[::-1]


def completions(counts: dict[int, int], largest: int, capacity: int) -> Iterator[tuple[Filling, int]]:
    """Undominated fillings around the largest item and their waste, least waste first.

    Among fillings of equal waste those with longer items come first, which keeps the
    short ones, that fit anywhere, for later.
    """
    rest = dict(counts)
    rest[largest] -= 1
    room = capacity - largest
    lengths = sorted((x for x, n in rest.items() if n and x <= room), reverse=True)
    reach = _sums(rest, lengths, room)
    available = sorted(lengths)

    def exact(i: int, total: int) -> Iterator[list[tuple[int, int]]]:
        if not total:
            yield []
            return
        for j in range(i, len(lengths)):
            if not reach[j] >> total & 1:
                return
            length = lengths[j]
            for n in range(min(rest[length], total // length), 0, -1):
                if reach[j + 1] >> (total - n * length) & 1:
                    for tail in exact(j + 1, total - n * length):
                        yield [(length, n), *tail]

    for total in range(room, -1, -1):
        if not reach[0] >> total & 1:
            continue
        for chosen in exact(0, total):
            waste = room - total
            if not _dominated(chosen, available, rest, waste):
                yield _with(largest, chosen), waste


def _with(largest: int, chosen: list[tuple[int, int]]) -> Filling:
    if chosen and chosen[0][0] == largest:
        return ((largest, chosen[0][1] + 1), *chosen[1:])
    return ((largest, 1), *chosen)


def _dominated(chosen, available: list[int], rest: dict[int, int], waste: int) -> bool:
    """Whether a longer unused item could replace one or two of the chosen."""
    used = dict(chosen)
    singles = [x for x, n in chosen]
    pairs = [x + y for i, x in enumerate(singles) for y in singles[i + 1 :]]
    pairs += [2 * x for x, n in chosen if n > 1]
    for low, high in [(x + 1, x + waste) for x in singles] + [(p, p + waste) for p in pairs]:
        at = bisect_left(available, low)
        while at < len(available) and available[at] <= high:
            if rest[available[at]] > used.get(available[at], 0):
                return True
            at += 1
    return False


def _choices(left: dict[int, int], capacity: int) -> Iterator[tuple[Filling, int, int]]:
    """(filling, times, waste of each), least waste first, each from most to fewest times."""
    for filling, waste in completions(left, max(left), capacity):
        times = min(left[length] // n for length, n in filling)
        while times:
            yield filling, times, waste
            times //= 2


def search(counts: dict[int, int], capacity: int, fewest: int, bound: int, nodes: int) -> Plan | None:
    """The best packing of fewer than ``fewest`` sequences that is found, if any.

    Depth first. A node is what was chosen there and how many choices went before; open
    items are put back on the way up. The choices of the last nodes are kept, those of
    others made anew.
    """
    left, volume, found = dict(counts), sum(x * n for x, n in counts.items()), None
    path: list[tuple[Filling, int, int]] = []  # filling, times, waste in all
    tried, kept = [0], {0: _choices(left, capacity)}
    used = waste = 0
    while tried and fewest > bound and nodes > 0:
        depth = len(tried) - 1
        if depth not in kept:
            kept[depth] = islice(_choices(left, capacity), tried[depth], None)
            kept.pop(depth + _KEPT_CHOICES, None)
        choice = next(kept[depth], None) if left else None
        allowed = (fewest - 1) * capacity - volume
        if choice is None or waste + choice[2] > allowed:
            # further fillings waste at least as much
            tried.pop()
            kept.pop(depth, None)
            if path:
                filling, times, lost = path.pop()
                used, waste = used - times, waste - lost
                for length, n in filling:
                    left[length] = left.get(length, 0) + n * times
            continue
        tried[depth] += 1
        filling, times, lost = choice
        if waste + times * lost > allowed:
            continue
        nodes -= 1
        _use(left, filling, times)
        path.append((filling, times, times * lost))
        used, waste = used + times, waste + times * lost
        if not left and used < fewest:
            found, fewest = [(f, t) for f, t, _ in path], used
        tried.append(0)
        if left:
            kept[depth + 1] = _choices(left, capacity)
            kept.pop(depth + 1 - _KEPT_CHOICES, None)
    return found


def _rounded(counts: dict[int, int], parts: list[tuple[np.ndarray, float]], capacity: int, nodes: int) -> Plan:
    """The whole parts of a fractional packing, and bin completion for the rest."""
    lengths, left, plan = sorted(counts), dict(counts), []
    for copies, used in sorted(parts, key=lambda p: -p[1]):
        filling = tuple((lengths[i], int(copies[i])) for i in np.flatnonzero(copies)[::-1])
        times = min([int(used + 1e-6), *[left.get(x, 0) // n for x, n in filling]])
        if times:
            plan.append(_use(left, filling, times))
    if not left:
        return plan
    rest = best_fit(left, capacity)
    fewest = sum(t for _, t in rest)
    bound = max(lower_bound(left, capacity), share_bound(left, capacity))
    return plan + (search(left, capacity, fewest, bound, nodes) or rest)


def solve(counts: dict[int, int], capacity: int = CAPACITY, effort: int | None = None) -> tuple[Plan, int]:
    """Fillings with their numbers of sequences, and sequences that no packing can do without."""
    counts = {length: n for length, n in counts.items() if n}
    bound = max(lower_bound(counts, capacity), share_bound(counts, capacity))
    nodes = NODES_PER_LENGTH * len(counts) if effort is None else effort
    best = best_fit(counts, capacity)
    fewest = sum(times for _, times in best)
    if fewest > bound * (1 + NARROW):
        sharper, parts = fractional(counts, capacity)
        bound = max(bound, sharper, slope_bound(counts, capacity))
        other = _rounded(counts, parts, capacity, nodes)
        if sum(times for _, times in other) < fewest:
            best, fewest = other, sum(times for _, times in other)
    return search(counts, capacity, fewest, bound, nodes) or best, bound


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, effort: int | None = None) -> Plan:
    """Fillings with their numbers of sequences, as few sequences as the search finds."""
    return solve(counts, capacity, effort)[0]


def gap(counts: dict[int, int], capacity: int = CAPACITY, effort: int | None = None) -> tuple[int, int]:
    """(sequences of the packing, sequences that any packing needs)."""
    plan, bound = solve(counts, capacity, effort)
    return sum(times for _, times in plan), bound


# --- placing the items --------------------------------------------------------------------


def _slots(plan: Plan) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank + 1, first sequence, copies a sequence, offset)."""
    sequence, ranked = 0, {}
    for filling, times in plan:
        offset = 0
        for length, n in filling:
            rank = ranked.get(length, 0)
            ranked[length] = rank + n * times
            yield length, rank, rank + n * times, sequence, n, offset
            offset += n * length
        sequence += times


def pack(pieces: DataFrame, capacity: int = CAPACITY, effort: int | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of a stored table of
    pieces; ids too, if the table has them."""
    spark = pieces.sparkSession
    kept = [c for c in pieces.columns if c in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")]
    pieces = pieces.select(*kept)
    lengths = pieces.groupBy("length").count()
    counts = {row["length"]: row["count"] for row in lengths.collect()}
    if any(not 0 < length <= capacity for length in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    slots = spark.createDataFrame(
        list(_slots(bin_completion(counts, capacity, effort))),
        "length long, low long, high long, sequence long, copies long, place long",
    )
    # groups of about the square root of the most common length, and as many of them
    group = max(256, math.isqrt(max(counts.values(), default=0)))
    salts = spark.createDataFrame(
        [(length, -(-n // group)) for length, n in counts.items()], "length long, salts long"
    )
    identity = [F.coalesce(F.col(c).cast("long"), F.lit(-1)) for c in ("doc_id", "piece")]
    salted = pieces.join(F.broadcast(salts), "length").withColumn(
        "salt", F.pmod(F.xxhash64(*identity, "ids_crc32"), F.col("salts"))
    )
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(
        Window.unboundedPreceding, -1
    )
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("size"))
    starts = sizes.select(
        "length", "salt", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("from")
    )
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        salted.withColumn("at", F.row_number().over(within) - 1)
        .join(starts, ["length", "salt"])
        .withColumn("rank", F.col("from") + F.col("at"))
    )
    # the plan has at most a few entries a length, so its size is bounded by the capacity
    placed = ranked.join(
        F.broadcast(slots),
        (ranked["length"] == slots["length"])
        & (F.col("rank") >= F.col("low"))
        & (F.col("rank") < F.col("high")),
    )
    turn = F.col("rank") - F.col("low")
    return placed.select(
        *[pieces[c] for c in kept],
        (F.col("sequence") + F.floor(turn / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("place") + turn % F.col("copies") * pieces["length"]).cast("long").alias("offset"),
    )


def pack_documents(
    docs: DataFrame, path: str, capacity: int = CAPACITY, effort: int | None = None, **options
) -> DataFrame:
    """Tokenise, cut and pack: a row per piece with its place."""
    pieces = stored(token_pieces(docs, path, capacity=capacity, **options), "packing-pieces")
    return pack(pieces, capacity, effort)
