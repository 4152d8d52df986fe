"""Byte-pair encoding as a streaming transducer with bounded lookahead, and its inverse.

Encoding. A vocabulary is a ranked list of merges. Of a word that is still arriving, a
later character can change the tokens only up to a certain distance back, and that
distance follows from the merges alone (``MergeTable.lookahead``). So the transducer
keeps the characters whose tokens may still change, emits every token that lies further
back than the lookahead, and needs the same memory for a word of ten letters and for one
of ten million.

The distance: let two continuations of the same text be merged side by side. They differ
only right of a frontier, at first the end of the known text. A merge (u, v) moves the
frontier left only by joining a u that ends at it with a v that starts at it, so by the
length of u; afterwards what starts at the new frontier begins with u. A further move
needs a later merge (u', v') whose v' begins with u, in its own derivation. The lookahead
is the longest total over such chains, found in one pass over the merges by rank.

Decoding. Tokens become bytes, bytes become text by an incremental state machine: a
character split over tokens waits until its last byte has come.

Words are encoded once and remembered, in a table of bounded size per worker. The
normaliser and the pre-tokeniser are those of the vocabulary file.

Defined results: a null text counts as empty; the empty text has no tokens and decodes to
the empty text; the vocabulary's special tokens are recognised in the text as the
tokenizers library does by default.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readyscope.llm.common import columns_of, unused, whole

REMEMBERED_WORDS = 300_000
BATCH_CHARACTERS = 4_000_000
LONG_WORD = 4096
SHORT_WORD = 48
_SLICE = 1 << 15


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves, the other bytes in ascending
    order for the characters from 256 on.
    """
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def _batches(texts: Iterable[str]) -> Iterator[list[str]]:
    """Texts in lists of a bounded number of characters, one longer text by itself."""
    batch, size = [], 0
    for text in texts:
        if batch and size + len(text) > BATCH_CHARACTERS:
            yield batch
            batch, size = [], 0
        batch.append(text)
        size += len(text)
    if batch:
        yield batch


class MergeTable:
    """Vocabulary and ranked merges; symbols are strings."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], end: str = ""):
        self.vocab, self.end = vocab, end
        self.ranks = {pair: rank for rank, pair in enumerate(merges)}
        self.lookahead = self._sufficient_lookahead()
        self._built = None

    def _length(self, symbol: str) -> int:
        return len(symbol) - len(self.end) if self.end and symbol.endswith(self.end) else len(symbol)

    def _sufficient_lookahead(self) -> int:
        """Characters behind the end of known text beyond which no token can change."""
        begins: dict[str, frozenset[str]] = {}  # what a symbol's derivation begins with
        reach: dict[str, int] = {}  # the farthest chain whose last merge has this left part
        for u, v in self.ranks:
            starts = begins.get(v, frozenset([v]))
            moved = self._length(u) + max(reach.get(s, 0) for s in starts)
            reach[u] = max(reach.get(u, 0), moved)
            own = begins.get(u, frozenset([u])) | {u + v}
            begins[u + v] = begins.get(u + v, frozenset()) | own
        return max(reach.values(), default=0)

    def merged(self, symbols: list[str]) -> list[str]:
        """Apply the merges: always the one of least rank, the leftmost first."""
        if len(symbols) > SHORT_WORD:
            return self._merged_long(symbols)
        ranks, parts = self.ranks, list(symbols)
        none = len(ranks)
        order = [ranks.get(pair, none) for pair in zip(parts, parts[1:], strict=False)]
        while order:
            least = min(order)
            if least == none:
                break
            at = order.index(least)
            parts[at] += parts.pop(at + 1)
            del order[at]
            if at:
                order[at - 1] = ranks.get((parts[at - 1], parts[at]), none)
            if at < len(order):
                order[at] = ranks.get((parts[at], parts[at + 1]), none)
        return parts

    def _arrays(self):
        """The merges as arrays: a sorted key per pair of ids, its rank, and each rank's product."""
        if self._built is None:
            ids = self.vocab
            keys = np.array([ids[u] << 32 | ids[v] for u, v in self.ranks], np.int64)
            order = np.argsort(keys)
            product = np.array([ids[u + v] for u, v in self.ranks], np.int64)
            self._built = keys[order], order, product
        return self._built

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys, ranks, _ = self._arrays()
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, ranks[at], len(keys))

    def merged_many(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Whole words, side by side: each with its token ids.

        Words of one length are the rows of a matrix. In each round every row joins its
        pair of least rank, so all rows that still have one keep the same length.
        """
        ids, none = self.vocab, len(self.ranks)
        by_length: dict[int, list[str]] = {}
        for word in words:
            by_length.setdefault(len(word), []).append(word)
        for length, group in by_length.items():
            letters = np.frombuffer("".join(group).encode("utf-32-le"), "<u4").reshape(-1, length)
            alphabet, codes = np.unique(letters, return_inverse=True)
            codes = codes.reshape(letters.shape)
            inner = np.array([ids[chr(c)] for c in alphabet], np.int64)
            final = np.array([ids[chr(c) + self.end] for c in alphabet], np.int64)
            symbols = np.concatenate([inner[codes[:, :-1]], final[codes[:, -1:]]], axis=1)
            ranks, rows = self._rank_of(symbols[:, :-1], symbols[:, 1:]), np.arange(len(group))
            while len(rows):
                least = ranks.min(axis=1, initial=none)
                done = least == none
                octets, width = symbols[done].astype("<u4").tobytes(), 4 * symbols.shape[1]
                for k, row in enumerate(rows[done]):
                    yield group[row], octets[k * width : (k + 1) * width]
                symbols, ranks, rows = symbols[~done], ranks[~done], rows[~done]
                if not len(rows):
                    break
                each, at = np.arange(len(rows)), ranks.argmin(axis=1)
                symbols[each, at] = self._arrays()[2][least[~done]]
                stays = np.arange(symbols.shape[1]) != at[:, None] + 1
                symbols = symbols[stays].reshape(len(rows), -1)
                ranks = ranks[stays[:, 1:]].reshape(len(rows), -1)
                for side in (at - 1, at):
                    some = np.flatnonzero((side >= 0) & (side < ranks.shape[1]))
                    pair = side[some]
                    ranks[some, pair] = self._rank_of(symbols[some, pair], symbols[some, pair + 1])

    def _merged_long(self, symbols: list[str]) -> list[str]:
        """The same with a queue of candidate merges, for long inputs."""
        parts: list[str | None] = list(symbols)
        after = [*range(1, len(parts)), -1]
        before = list(range(-1, len(parts) - 1))
        ranks = self.ranks
        queue = [
            (ranks[pair], i, *pair)
            for i, pair in enumerate(zip(parts, parts[1:], strict=False)) if pair in ranks
        ]
        heapify(queue)
        while queue:
            _, i, u, v = heappop(queue)
            j = after[i]
            if parts[i] != u or j < 0 or parts[j] != v:
                continue  # one of the two has been merged since
            parts[i], parts[j] = u + v, None
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (pair := (parts[i], parts[k])) in ranks:
                    heappush(queue, (ranks[pair], i, *pair))
            if (h := before[i]) >= 0 and (pair := (parts[h], parts[i])) in ranks:
                heappush(queue, (ranks[pair], h, *pair))
        return [p for p in parts if p is not None]


class WordEncoder:
    """The transducer for one word: characters in, token ids out once they are stable."""

    def __init__(self, table: MergeTable, capacity: int = LONG_WORD):
        self.table = table
        self.capacity = max(capacity, 2 * table.lookahead + 2)
        self.pending: list[str] = []

    def feed(self, characters: str) -> list[int]:
        ids: list[int] = []
        for at in range(0, len(characters), self.capacity):
            self.pending += characters[at : at + self.capacity]
            if len(self.pending) > self.capacity:
                ids += self._stable()
        return ids

    def _stable(self) -> list[int]:
        # the last character may yet turn out to end the word, so it is not known text
        known, ids = self.pending[:-1], []
        settled, at = len(known) - self.table.lookahead, 0
        for token in self.table.merged(known):
            if at + len(token) > settled:
                break
            ids.append(self.table.vocab[token])
            at += len(token)
        self.pending = self.pending[at:]
        return ids

    def flush(self) -> list[int]:
        """End of the word: all that waits is emitted."""
        if not self.pending:
            return []
        self.pending[-1] += self.table.end
        tokens, self.pending = self.table.merged(self.pending), []
        return [self.table.vocab[t] for t in tokens]


class TokenDecoder:
    """The inverse: token ids in, text out as soon as its bytes are complete."""

    def __init__(self, tokens: list[bytes], between: bytes):
        self.tokens, self.between, self.begun = tokens, between, False
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        tokens = self.tokens
        octets = self.between.join([tokens[i] for i in ids])
        if self.begun:
            octets = self.between + octets
        self.begun = True
        return self.machine.decode(octets)

    def flush(self) -> str:
        return self.machine.decode(b"", final=True)


class Codec:
    """Encoder and decoder of one vocabulary file of byte-level BPE with word ends."""

    # Characters that the normaliser only lower-cases, and ASCII white space: composed
    # Latin letters, no combining marks
    _PLAIN = re.compile(r"[\t-\r\x20-\x7e\xa1-\xac\xae-įı-ňŊ-ž]*")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.library = Tokenizer.from_file(path)
        merges = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
        self.table = MergeTable(model["vocab"], merges, model["end_of_word_suffix"] or "")
        split, byte_level = spec["pre_tokenizer"]["pretokenizers"]
        if spec["normalizer"] is None or split["type"] != "Split" or byte_level["use_regex"]:
            raise ValueError(f"{path} is not a vocabulary with word ends")
        self.word = regex.compile(split["pattern"]["Regex"])
        self.as_characters = dict(enumerate(byte_characters()))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # under names that no word has
        self.special_words = {"\n" + s: np.uint32(i).tobytes() for s, i in self.special.items()}
        self.special_pattern = re.compile(f"({'|'.join(map(re.escape, self.special))})")
        surfaces = model["vocab"] | self.special
        self.tokens = [b""] * (max(surfaces.values()) + 1)
        for surface, number in surfaces.items():
            self.tokens[number] = surface.encode()
        # without a decoder the library joins the tokens as they are with blanks
        if spec["decoder"] is not None:
            raise ValueError(f"{path} names a decoder")
        self.words: dict[str, bytes] = dict(self.special_words)
        self.pieces: dict[str, bytes] = {}

    def _words(self, text: str) -> list[str]:
        """The normalised text at its white space, special tokens by their own names."""
        if "<|" in text and self.special_pattern.search(text):
            parts = self.special_pattern.split(text)
            lists = [["\n" + p] if p in self.special else self._words(p) for p in parts]
            return [word for words in lists for word in words]
        if self._PLAIN.fullmatch(text):
            return text.lower().split()
        return [w for w in self.library.normalizer.normalize_str(text).split(" ") if w]

    def _pieces(self, word: str) -> list[str]:
        """The pre-tokens of a word, a character a byte."""
        if word.isascii():
            # its characters stand for themselves, but for control characters
            if word.isalpha():
                return [word]
            if word.isprintable():
                return self.word.findall(word)
        if not self._PLAIN.fullmatch(word):
            return [piece for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(word)]
        pieces = [word] if word.isalpha() else self.word.findall(word)
        table = self.as_characters
        return [p.encode().decode("latin-1").translate(table) for p in pieces]

    def _learn(self, words: set[str]) -> None:
        """Encode words that are not remembered."""
        split = {word: self._pieces(word) for word in words}
        new = set().union(*split.values()).difference(self.pieces)
        # a short word is all within the lookahead: its tokens are stable when it ends
        self.pieces.update(self.table.merged_many([p for p in new if len(p) <= SHORT_WORD]))
        for piece in new:
            if len(piece) > SHORT_WORD:
                encoder = WordEncoder(self.table)
                ids = encoder.feed(piece) + encoder.flush()
                self.pieces[piece] = np.array(ids, "<u4").tobytes()
        known = self.pieces.__getitem__
        for word, pieces in split.items():
            self.words[word] = b"".join(map(known, pieces))

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        known = self.words
        for batch in _batches(texts):
            split = [self._words(text) for text in batch]
            needed = set().union(*split)
            unknown = needed.difference(known)
            if len(known) + len(unknown) > REMEMBERED_WORDS:
                # start over, so that memory stays bounded; common words soon return
                known.clear()
                self.pieces.clear()
                known.update(self.special_words)
                unknown = needed.difference(known)
            self._learn(unknown)
            for words in split:
                yield b"".join(map(known.__getitem__, words))

    def decode(self, ids: np.ndarray) -> Iterator[str]:
        decoder = TokenDecoder(self.tokens, b" ")
        for at in range(0, len(ids), _SLICE):
            yield decoder.feed(ids[at : at + _SLICE].tolist())
        yield decoder.flush()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the token ids of a text column, as an array of int."""

    @F.pandas_udf("array<int>")
    def encoded(texts: pd.Series) -> pd.Series:
        found = codec(path).encode(texts)
        return pd.Series([np.frombuffer(ids, "<u4").astype(np.int32) for ids in found])

    return docs.withColumn(ids, encoded(whole(text)))


def decode(rows: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text of a column of token ids; null ids give null."""

    @F.pandas_udf("string")
    def decoded(columns: pd.Series) -> pd.Series:
        own = codec(path)
        return columns.map(lambda i: None if i is None else "".join(own.decode(i)))

    return rows.withColumn(text, decoded(F.col(ids)))


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add n_tokens, ids_sha256 and decoded_sha256: encode each text, then decode its ids.

    Neither ids nor decoded text leave the worker, which checks large corpora cheaply.
    The text is left out; other columns stay, but for those that the results replace.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(texts: pd.Series) -> pd.DataFrame:
        own, out = codec(path), []
        for encoded in own.encode(texts):
            ids = np.frombuffer(encoded, "<u4")
            sha = hashlib.sha256()
            for part in own.decode(ids):
                sha.update(part.encode())
            out.append((len(ids), hashlib.sha256(encoded).hexdigest(), sha.hexdigest()))
        return pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    results, own = ("n_tokens", "ids_sha256", "decoded_sha256"), unused(docs, "_found")
    found = docs.withColumn(own, digests(whole(text)))
    return found.select(*columns_of(docs, text, *results), f"{own}.*")
