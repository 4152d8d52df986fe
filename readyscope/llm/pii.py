"""Personal data: known formats, and further candidates judged by boosted trees.

Known formats are patterns with checks; their accepted matches are always reported.

Beside them, high-recall generators propose spans, which may overlap: anything around an
"@" or a spelled-out one, and any run of digits and separators, whole and in parts.
Boosted trees judge each by its format (digits, groups, separators, checksum) and its
context (the words before it). No labels are given, so the trees learn from the known
formats: a candidate inside a reported span is an example of personal data, and so is
every reported address and phone rewritten, in its real context, into forms that no
pattern knows: spelled out, without its sign, in local or identity-number groups. A
candidate that touches no reported span is a counter-example, unless a word before it
announces personal data; then it teaches nothing, as does one that holds less than ``MOST``
of a reported span.

Addresses and numbers have trees of their own. Half of the sample trains them, the other
half calibrates them (isotonic) and sets the threshold of each kind: the chance that finds
most examples for the counter-examples it takes (F1), ``CHANCE`` at least. Of selected spans
that overlap the likelier stays; known formats always stay.

The sample is bounded (``SAMPLE`` distinct feature rows with the least hash, each with its
numbers of examples and counter-examples); every text is scanned whole and every candidate
judged.

Defined results: a null text counts as empty and has no spans; offsets count code points;
without examples of both kinds nothing is selected beside the known formats.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readyscope.llm import spans as S
from readyscope.llm.boosting import Trees, calibration, fit_trees
from readyscope.llm.common import columns_of, stored, unused, whole

SAMPLE = 20_000
# Counter-examples of an unknown form may be personal data themselves, so even chances are
# not asked of the least likely
CHANCE = 0.25
MOST = 0.7

KINDS = ["email", "ip", "card", "phone", "contact", "number"]

_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# the leftmost match begins where a run of digits does, so no other place is tried
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

# An "@" within a word, or spelled out, in brackets or not, with a point or a "dot" after
_WORD = re.compile(r"\S+")
_AT = re.compile(r"[^\s@]@[^\s@]")
_SPELLED = re.compile(
    r"\b\w++\x20?[\[(]?\x20?\bat\b\x20?[\])]?\x20?\w++"
    r"(?:\x20?(?:\.|[\[(]?\bdot\b[\])]?)\x20?\w++)+"
)
# No known kind of number has fewer digits, or more
FEWEST_DIGITS, MOST_DIGITS = 6, 19
_NUMBERS = re.compile(r"[+(]{0,2}[0-9](?:[\x20().:/-]{0,2}[0-9])+")
_CONTEXT = re.compile(r"\w+")
# A feature: whether one of these words stands just before
_ANNOUNCING = frozenset(
    "phone tel telephone mobile cell fax call text whatsapp contact email mail write reach"
    " ssn social passport iban account card visa mastercard ip address host dob born".split()
)
_CONTEXT_CHARACTERS = 40


def emails(text: str) -> Iterator[S.Span]:
    """The leftmost non-overlapping matches of the email pattern, found from each "@".

    The local part is the whole run of its characters before the "@", as far as the last
    match lets it: that is where a search from the left would begin it.
    """
    at = done = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        at += 1
        if domain:
            yield "email", start, domain.end()
            at = done = domain.end()


def luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def _is_card(match: re.Match) -> bool:
    digits = _NOT_DIGIT.sub("", match[0])
    return 12 <= len(digits) <= 19 and luhn(digits)


def _is_ip(match: re.Match) -> bool:
    # by length first: int() refuses very long numbers
    parts = (part.lstrip("0") for part in match[0].split("."))
    return all(len(part) <= 3 and int(part or 0) <= 255 for part in parts)


def _is_phone(match: re.Match) -> bool:
    return 9 <= len(_NOT_DIGIT.sub("", match[0])) <= 15


def base_spans(text: str) -> list[S.Span]:
    found = [
        *emails(text),
        *S.matches("ip", _IP, _is_ip, text),
        *S.matches("card", _CARD, _is_card, text),
        *S.matches("phone", _PHONE, _is_phone, text),
    ]
    return S.in_order(found, KINDS)


def candidates(text: str) -> Iterator[S.Span]:
    """Spans that may be personal data, overlapping ones among them.

    Their number and length grow with the text, whatever it holds: a run of numbers of any
    length has a bounded number of proposals for each of its groups.
    """
    found = []
    if "@" in text:
        found += [m.span() for m in _WORD.finditer(text) if "@" in m[0] and _AT.search(m[0])]
    if " at " in text or "(at)" in text or "[at]" in text:
        found += [m.span() for m in _SPELLED.finditer(text)]
    for start, end in sorted(found):
        while end > start and text[end - 1] in ".,;:!?)]}>\"'":
            end -= 1
        if start < end:
            yield "contact", start, end
    for match in _NUMBERS.finditer(text):
        for a, b in _proposals(text, *match.span()):
            yield "number", a, b


def _proposals(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Parts of a run of digit groups, divided at blanks.

    Of a run that may be one number: all of it, without its sign, and what is before or
    after each blank. Of a longer one: from each group on, the fewest groups that have
    enough digits and the most that do not have too many; a group with more stands alone.
    """
    groups = [(start + m.start(), start + m.end()) for m in re.finditer(r"[^\x20]+", text[start:end])]
    digits = [sum(c in string.digits for c in text[a:b]) for a, b in groups]
    if sum(digits) <= MOST_DIGITS:
        first = start
        while text[first] not in string.digits + "(":
            first += 1
        chosen = {(start, end), (first, end)}
        chosen |= {(start, b) for _, b in groups} | {(a, end) for a, _ in groups}
        total = {s: sum(c in string.digits for c in text[s[0] : s[1]]) for s in chosen}
        yield from sorted(s for s, n in total.items() if n >= FEWEST_DIGITS)
        return
    for i, (a, b) in enumerate(groups):
        held, last, short = 0, i, None
        while last < len(groups) and held + digits[last] <= MOST_DIGITS:
            held += digits[last]
            if short is None and held >= FEWEST_DIGITS:
                short = groups[last][1]
            last += 1
        if last == i:
            yield a, b
        elif short is not None:
            yield a, short
            if groups[last - 1][1] != short:
                yield a, groups[last - 1][1]


_DOT, _BRACKETED_AT = re.compile(r"\bdot\b"), re.compile(r"[\[(]\x20?at\x20?[\])]")


def rewritten(kind: str, token: str) -> list[str]:
    """A known span in the ways people write it where no pattern looks: an address spelled
    out, a number without its sign, by local habits or in groups like an identity number."""
    if kind == "email":
        local, _, domain = token.partition("@")
        spelled = domain.replace(".", " dot ")
        return [
            f"{local} at {spelled}", f"{local} (at) {domain}", f"{local}(at){domain}",
            f"{local}[at]{domain.replace('.', '[dot]')}", f"{local} at {domain}",
        ]
    d = _NOT_DIGIT.sub("", token)
    return [
        token[1:].lstrip("("), f"({d[-10:-7]}) {d[-7:-4]}-{d[-4:]}", f"{d[-10:-7]}-{d[-7:-4]}-{d[-4:]}",
        f"{d[-10:-7]}.{d[-7:-4]}.{d[-4:]}", f"0{d[-9:-7]} {d[-7:]}", f"(0{d[-9:-7]}) {d[-7:]}",
        f"{d[-9:-6]}-{d[-6:-4]}-{d[-4:]}", f"{d[-10:-7]} {d[-7:-4]} {d[-4:]}",
    ]


FEATURES = [
    "spelled_dot", "bracketed_at", "open_dots",
    "digits", "letters", "length", "groups", "longest_group", "shortest_group", "blanks",
    "dots", "dashes", "slashes", "brackets", "at_signs", "dotted_tail", "luhn", "largest_octet",
    "zero_first", "announced", "word_before", "word_after", "line_start",
]


def features(text: str, start: int, end: int) -> list[float]:
    """Format and context of a span. A leading plus is left out: it would give away the
    one known format that has it."""
    token = text[start:end]
    digits = _NOT_DIGIT.sub("", token)
    groups = [len(g) for g in re.findall(r"[0-9]+", token)] or [0]
    parts = re.findall(r"[0-9]+", token)
    octet = max((min(int(p), 999) for p in parts if len(p) < 19), default=0) if "." in token else -1
    tail = token.rpartition(".")[2]
    before = text[max(0, start - _CONTEXT_CHARACTERS) : start]
    words = [w.lower() for w in _CONTEXT.findall(before)][-4:]
    return [
        float(bool(_DOT.search(token))), float(bool(_BRACKETED_AT.search(token))), token.count(". "),
        len(digits), sum(c.isalpha() for c in token), end - start, len(groups), max(groups),
        min(groups), token.count(" "), token.count("."), token.count("-"), token.count("/"),
        token.count("(") + token.count(")"), token.count("@"),
        len(tail) if tail != token and tail.isalpha() else 0, float(luhn(digits)) if digits else 0.0,
        octet, float(digits[:1] == "0"), float(any(w in _ANNOUNCING for w in words)),
        float(before[-1:].isalnum()), float(text[end : end + 1].isalnum()),
        float(start == 0 or text[start - 1] == "\n"),
    ]


_ANNOUNCED = FEATURES.index("announced")
# Of an address only the form and the context count, not what it is made of: the known
# addresses of a corpus may all have digits, or none
_OF_THE_FORM = np.isin(FEATURES, [
    "spelled_dot", "bracketed_at", "open_dots", "brackets", "at_signs", "dotted_tail",
    "announced", "word_before", "word_after", "line_start",
])


def seen_by(kind: str, rows: list[list[float]]) -> np.ndarray:
    """The features that the trees of a kind look at."""
    x = np.array([list(row) for row in rows], np.float64)
    return x * _OF_THE_FORM if kind == "contact" else x


def examples(text: str, base: list[S.Span]) -> Iterator[tuple[str, list[float]]]:
    """(kind, features) of the known addresses and phones of a text, rewritten in place."""
    for kind, start, end in base:
        if kind in ("email", "phone"):
            before = text[max(0, start - 2 * _CONTEXT_CHARACTERS) : start]
            for token in rewritten(kind, text[start:end]):
                row = features(before + token + text[end : end + 2], len(before), len(before) + len(token))
                yield "contact" if kind == "email" else "number", row


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``base`` spans and ``candidates`` with features and what is known of each.

    Known is 1 for most of a base span, and for a base span rewritten, which has no place
    (start -1); null for what touches a base span otherwise. Of the others, those that a
    word before announces are -1: nothing tells that they are not personal data, so they
    are no counter-examples. The rest are 0.
    """
    schema = (
        f"base {S.SPANS}, candidates array<struct<kind:string,start:int,end:int,"
        "known:int,features:array<float>>>"
    )

    @F.pandas_udf(schema)
    def scanned(texts: pd.Series) -> pd.DataFrame:
        out = []
        for one in texts:
            base, found = base_spans(one), []
            known_spans = S.Overlaps(base)
            for kind, a, b in candidates(one):
                near = list(known_spans.at(a, b))
                known = int(any(s <= a and b <= e and b - a >= MOST * (e - s) for _, s, e in near))
                row = features(one, a, b)
                if not known:
                    known = None if near else -1 if row[_ANNOUNCED] else 0
                found.append((kind, a, b, known, row))
            found += [(kind, -1, -1, 1, row) for kind, row in examples(one, base)]
            out.append((base, found))
        return pd.DataFrame(out, columns=["base", "candidates"])

    own = unused(docs, "_found")
    return docs.withColumn(own, scanned(whole(text))).select(
        *columns_of(docs, "base", "candidates", "spans"), f"{own}.base", f"{own}.candidates"
    )


@dataclass(frozen=True)
class Judge:
    trees: Trees
    margins: np.ndarray
    chances: np.ndarray
    least: float  # chance from which on a candidate of the kind is taken

    def chance(self, rows: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.margins, self.trees.margin(rows), "right") - 1
        return np.where(at < 0, 0.0, self.chances[np.maximum(at, 0)])


def fit(scanned: DataFrame, sample: int = SAMPLE, chance: float = CHANCE) -> dict[str, Judge]:
    """Trees, calibration and threshold of each kind, from the candidates of a bounded
    sample of feature rows."""
    rows = scanned.select(F.explode("candidates").alias("c")).where("c.known >= 0")
    counts = rows.groupBy("c.kind", "c.features").agg(
        F.sum("c.known").alias("yes"), F.sum(1 - F.col("c.known")).alias("no")
    )
    order = [F.xxhash64("features"), F.col("features")]
    judges = {}
    for kind in ("contact", "number"):
        found = counts.where(F.col("kind") == kind).orderBy(*order).limit(sample // 2).toPandas()
        judge = _fit_kind(seen_by(kind, found["features"].tolist()), found, chance) if len(found) else None
        if judge is not None:
            judges[kind] = judge
    return judges


def _fit_kind(x: np.ndarray, found: pd.DataFrame, chance: float) -> Judge | None:
    yes, no = found["yes"].to_numpy(np.float64), found["no"].to_numpy(np.float64)
    train = np.arange(len(x)) % 2 == 0
    if any(not side[half].sum() for side in (yes, no) for half in (train, ~train)):
        return None

    def both(half):
        """Every feature row once as an example and once as a counter-example."""
        labels = np.repeat([1.0, 0.0], half.sum())
        return np.concatenate([x[half], x[half]]), labels, np.concatenate([yes[half], no[half]])

    trees = fit_trees(*both(train))
    held, labels, weights = both(~train)
    seen = weights > 0
    judge = Judge(trees, *calibration(trees.margin(held)[seen], labels[seen], weights[seen]), 1.0)
    # the chance at which examples found and counter-examples left are in best balance (F1)
    chance_of = judge.chance(x[~train])
    down = np.argsort(-chance_of, kind="stable")
    right, taken = np.cumsum(yes[~train][down]), np.cumsum((yes + no)[~train][down])
    balance = 2 * right / (taken + right[-1])
    # only where a chance ends: candidates of one chance are taken together
    balance[np.diff(chance_of[down], append=-1.0) == 0] = 0
    best = float(chance_of[down][balance.argmax()])
    return Judge(trees, judge.margins, judge.chances, max(chance, best))


def find_pii(
    docs: DataFrame, text: str = "text", chance: float = CHANCE, sample: int = SAMPLE
) -> DataFrame:
    """The columns of ``docs`` without the text, with ``base`` spans and ``spans``: those
    and the selected candidates."""
    rows = stored(scan(docs, text).drop(text), "pii-scan")
    judges = fit(rows, sample, chance)
    if not judges:
        return rows.withColumn("spans", F.col("base")).drop("candidates")

    @F.pandas_udf(S.SPANS)
    def selected(bases: pd.Series, proposals: pd.Series) -> pd.Series:
        out = []
        for base, found in zip(bases, proposals, strict=True):
            kept, taken = [(s["kind"], s["start"], s["end"]) for s in base], S.Taken()
            # candidates that a known span touches are settled
            ranked = []
            for kind, judge in judges.items():
                free = [c for c in found if c["kind"] == kind and c["known"] in (0, -1)]
                if free:
                    chances = judge.chance(seen_by(kind, [c["features"] for c in free]))
                    ranked += [
                        (-p, c["start"], -c["end"], kind)
                        for p, c in zip(chances, free, strict=True) if p >= judge.least
                    ]
            for _, start, end, kind in sorted(ranked):
                if taken.take(start, -end):
                    kept.append((kind, start, -end))
            out.append(S.in_order(kept, KINDS))
        return pd.Series(out, dtype="object")

    return rows.withColumn("spans", selected("base", "candidates")).drop("candidates")
