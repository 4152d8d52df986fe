"""Secrets: known formats, and strings too random to be text.

Known formats are patterns, whose matches are always reported. Beside them, every token of
``MIN_LENGTH`` or more is a candidate, with digits or without, and so is each of its parts between signs, whichever of them
are taken as glue: a key may hang on a name or a path by a sign that keys hold as well. An
"=" is always glue, as it only pads. The encoding of a candidate is the smallest alphabet that holds it, and its
symbols go through a battery of tests for randomness: chi-squared for a uniform alphabet,
a runs test, and the serial correlation of neighbours. A candidate must pass all three.

Passing says little of a short string, as any test forgives those. So each candidate also
has a p-value against the opposite claim, that it is as uneven as text: the chance that
text of its length fits its alphabet so evenly (a noncentral chi-squared, whose centre
grows with the length). These p-values go through the Benjamini-Hochberg procedure over
all candidates of the corpus, which bounds the share of false discoveries at ``RATE``.
It needs only the number of candidates per rounded p-value, a table of bounded size.
Discoveries that overlap are reported as one span.

Random letters of one case look much like text by their frequencies: 16 of them are tested,
but seldom tell enough to be discoveries.

Defined results: a null text counts as empty and has no spans; offsets count code points;
repeated rows are judged alike, each counts among the candidates.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readyscope.llm import spans as S
from readyscope.llm.common import columns_of, stored, unused, whole

RATE = 0.05
MIN_LENGTH = 16
ALPHA = 0.001

KINDS = ["assign", "access", "hex", "random"]
_ANY_CASE = "|".join(
    "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
    for word in ("password", "passwd", "secret", "token", "api_?key")
)
_ASSIGN = re.compile(rf"(?:{_ANY_CASE})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# a run of 32 or more, which a run of any length would match as a whole
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")

_SIGNS = "+/_-"

# Alphabets by size; the first that holds a token is its encoding
_DIGITS, _LOWER, _UPPER = string.digits, string.ascii_lowercase, string.ascii_uppercase
ENCODINGS = {
    "decimal": _DIGITS,
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "lower letters": _LOWER,
    "upper letters": _UPPER,
    "base32": "234567" + _UPPER,
    "lower": _DIGITS + _LOWER,
    "upper": _DIGITS + _UPPER,
    "letters": _LOWER + _UPPER,
    "alphanumeric": _DIGITS + _LOWER + _UPPER,
    "base64": _DIGITS + _LOWER + _UPPER + "+/",
    "base64url": _DIGITS + _LOWER + _UPPER + "-_",
}
# The sum of squared letter frequencies of European text, by which it is uneven
_TEXT_REPEATS = 0.066


def base_spans(text: str) -> list[S.Span]:
    found = [
        *S.matches("assign", _ASSIGN, lambda m: len(m[1]) >= 8, text),
        *S.matches("access", _ACCESS, lambda m: len(m[0]) >= 16, text),
        *S.matches("hex", _HEX, lambda m: True, text),
    ]
    return S.in_order(found, KINDS)


def candidates(text: str, min_length: int = MIN_LENGTH) -> Iterator[tuple[int, int]]:
    """Maximal runs of token characters and their parts between signs, without the signs
    around them. Parts may overlap."""
    run = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{min_length},}}"
    for found in re.finditer(run, text):
        for start, end in sorted(_parts(found[0], min_length)):
            yield found.start() + start, found.start() + end


def _parts(run: str, min_length: int) -> set[tuple[int, int]]:
    """The run and its parts, with every choice of its signs as the glue between them."""
    signs = [sign for sign in _SIGNS if sign in run]
    parts = set()
    for size in range(len(signs) + 1):
        for glue in combinations(signs, size):
            start = 0
            for part in re.split(f"[{''.join(glue)}]", run) if glue else [run]:
                bare = part.strip(_SIGNS)
                if len(bare) >= min_length:
                    at = start + len(part) - len(part.lstrip(_SIGNS))
                    parts.add((at, at + len(bare)))
                start += len(part) + 1
    return parts


def _class(character: str) -> str:
    if character.isdigit():
        return "digit"
    return "lower" if character.islower() else "upper" if character.isupper() else "sign"


def _normal_below(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def chi_squared_below(x: float, degrees: int, centre: float = 0.0) -> float:
    """Distribution function of the noncentral chi-squared, by Sankaran's approximation."""
    if x <= 0:
        return 0.0
    mean, wide = degrees + centre, degrees + 2 * centre
    h = 1 - 2 * mean * (degrees + 3 * centre) / (3 * wide**2)
    p = wide / mean**2
    m = (h - 1) * (1 - 3 * h)
    middle = 1 + h * p * (h - 1 - 0.5 * (2 - h) * m * p)
    spread = h * math.sqrt(2 * p) * (1 + 0.5 * m * p)
    return _normal_below(((x / mean) ** h - middle) / spread)


def encoding_of(token: str) -> str | None:
    held = set(token)
    return next((name for name, alphabet in ENCODINGS.items() if held <= set(alphabet)), None)


def battery(token: str, alphabet: str) -> tuple[float, float, float, float]:
    """p-values: against randomness by frequencies, runs and serial correlation; and against
    text."""
    n, k = len(token), len(alphabet)
    place = {c: i for i, c in enumerate(alphabet)}
    symbols = [place[c] for c in token]
    chi = k / n * sum(c * c for c in Counter(symbols).values()) - n
    # short tokens leave most symbols out, but not whole classes of them
    seen, sizes = Counter(map(_class, token)), Counter(map(_class, alphabet))
    classes = sum((seen[c] - n * m / k) ** 2 / (n * m / k) for c, m in sizes.items())
    frequencies = 1 - chi_squared_below(chi, k - 1)
    if len(sizes) > 1:
        frequencies = min(1, 2 * min(frequencies, 1 - chi_squared_below(classes, len(sizes) - 1)))
    text = chi_squared_below(chi, k - 1, n * max(0.7, k * _TEXT_REPEATS - 1))

    high = [2 * s >= k for s in symbols]
    ups = sum(high)
    downs = n - ups
    runs = 1.0
    expected = 2 * ups * downs / n + 1
    variance = (expected - 1) * (expected - 2) / (n - 1)
    if variance > 0:
        seen = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
        runs = math.erfc(abs(seen - expected) / math.sqrt(2 * variance))
    else:
        runs = 2.0 ** (1 - n)  # all on one side

    mean = sum(symbols) / n
    spread = sum((s - mean) ** 2 for s in symbols)
    serial = 0.0
    if spread:
        near = sum((a - mean) * (b - mean) for a, b in zip(symbols, symbols[1:], strict=False))
        # neighbours of a random sequence have the mean correlation -1/n
        serial = math.erfc(abs(near / spread + 1 / n) * math.sqrt(n) / math.sqrt(2))
    return frequencies, runs, serial, text


def judge(token: str) -> float | None:
    """The p-value against text, 1 for a token that is not random, None without encoding."""
    encoding = encoding_of(token)
    if encoding is None or encoding == "decimal":
        return None  # numbers are not secrets by themselves
    *random, text = battery(token, ENCODINGS[encoding])
    return text if min(random) >= ALPHA else 1.0


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``base`` spans and ``candidates`` with the rounded -log10 of their p-values and
    whether they lie free of the base spans."""
    candidate = "struct<start:int,end:int,level:int,free:boolean>"
    schema = f"base {S.SPANS}, candidates array<{candidate}>"

    @F.pandas_udf(schema)
    def scanned(texts: pd.Series) -> pd.DataFrame:
        out = []
        for one in texts:
            base, found = base_spans(one), []
            known = S.Overlaps(base)
            for start, end in candidates(one):
                p = judge(one[start:end])
                if p is not None:
                    # rounded towards less evidence, in hundredths
                    level = int(-100 * math.log10(max(p, 1e-300)))
                    found.append((start, end, level, not any(known.at(start, end))))
            out.append((base, found))
        return pd.DataFrame(out, columns=["base", "candidates"])

    own = unused(docs, "_found")
    return docs.withColumn(own, scanned(whole(text))).select(
        *columns_of(docs, "base", "candidates", "spans"), f"{own}.base", f"{own}.candidates"
    )


def least_level(counts: dict[int, int], rate: float = RATE) -> int | None:
    """Benjamini-Hochberg: the least level whose candidates are discoveries, or None."""
    total, rank, least = sum(counts.values()), 0, None
    for level in sorted(counts, reverse=True):
        rank += counts[level]
        if 10 ** (-level / 100) <= rate * rank / total:
            least = level
    return least


def find_secrets(docs: DataFrame, text: str = "text", rate: float = RATE, keep_text: bool = False):
    """The columns of ``docs`` (without the text unless asked for), with ``base`` spans and
    ``spans``: those and the discoveries outside them."""
    scanned = scan(docs, text)
    rows = stored(scanned if keep_text else scanned.drop(text), "secrets-scan")
    levels = rows.select(F.explode("candidates.level").alias("level")).groupBy("level").count()
    # at most one row per hundredth of a power of ten down to 1e-300
    least = least_level({r["level"]: r["count"] for r in levels.collect()}, rate)
    return rows.withColumn("spans", _all_spans(least)).drop("candidates")


def _merge(places: Iterable[tuple[int, int]]) -> list[S.Span]:
    """The places in order, those that overlap as one."""
    out: list[S.Span] = []
    for start, end in sorted(places):
        if out and start < out[-1][2]:
            out[-1] = ("random", out[-1][1], max(out[-1][2], end))
        else:
            out.append(("random", start, end))
    return out


def _all_spans(least: int | None) -> Column:
    base = F.col("base")
    if least is None:
        return base
    found = F.filter(F.col("candidates"), lambda c: (c["level"] >= least) & c["free"])

    @F.pandas_udf(S.SPANS)
    def merged(discoveries: pd.Series) -> pd.Series:
        rows = [None if d is None else _merge((c["start"], c["end"]) for c in d) for d in discoveries]
        return pd.Series(rows, dtype="object")

    # only rows with discoveries go to the workers
    added = F.coalesce(merged(F.when(F.size(found) > 0, found)), F.array().cast(S.SPANS))
    # none of the added overlaps another or a base span, so starts decide; base spans that
    # start together are already in the order of their kinds
    order = {kind: i for i, kind in enumerate(KINDS)}

    def first(a: Column, b: Column) -> Column:
        def rank(s: Column) -> Column:
            return F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), s["kind"])

        by_kind = F.when(rank(a) < rank(b), -1).when(rank(a) > rank(b), 1).otherwise(0)
        return F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(by_kind)

    return F.array_sort(F.concat(base, added), first)


def without_secrets(docs: DataFrame, text: str = "text", rate: float = RATE) -> DataFrame:
    """The documents with every secret replaced by its kind in brackets."""
    # the spans go by names of their own, so that columns of the same name pass through
    hidden = {c: unused(docs, f"_{c}") for c in ("base", "candidates", "spans") if c in docs.columns}
    found = find_secrets(docs.withColumnsRenamed(hidden), text, rate, keep_text=True)

    @F.pandas_udf("string")
    def redacted(texts: pd.Series, spans: pd.Series) -> pd.Series:
        pairs = zip(texts, spans, strict=True)
        return pd.Series(
            [t if s is None or not len(s) else S.redact(t, [(x["kind"], x["start"], x["end"]) for x in s])
             for t, s in pairs],
            dtype="object",
        )

    clean = F.when(F.size("spans") > 0, redacted(F.col(text), F.col("spans"))).otherwise(F.col(text))
    edited = found.withColumn(text, clean).drop("base", "spans")
    return edited.withColumnsRenamed({b: a for a, b in hidden.items()}).select(*columns_of(docs))
