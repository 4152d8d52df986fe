"""Quality rules and a hashed n-gram likelihood ratio, in DataFrame functions only.

Words and pairs of words are hashed into buckets. Two multinomials over the buckets are
counted: that of trusted documents and that of the whole corpus. A document's score is
its mean log-likelihood ratio per n-gram between the two, and a document is kept if its
score reaches ``THRESHOLD``, a fixed number, so the verdict on a document depends on
nothing but its text and the two counts. Ordinary text scores about zero whatever its
topic, for the corpus consists mostly of it; text made of n-grams that trusted documents
lack scores far below.

The trusted counts come from at most ``SAMPLE`` documents labelled good, those with the
least hash of their id; that bound is what lets their ids be broadcast. The corpus counts
cover every document. Both are summed per task first, so a frequent word costs no shuffle.
The ratios are a table of fixed size that becomes a constant of the scoring expression.

Defined results: a null text has no words; a text without words has no score and fails
the base rules; null or contradicting labels are not trusted; without any trusted
document every ratio is zero.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readyscope.llm.common import stored, unused, whole

BUCKETS = 1 << 14
SAMPLE = 20_000
THRESHOLD = -0.1
PRIOR = 50_000

MIN_WORDS = 50
MAX_REPEATED_PCT = 50
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, "[ \t-\r]+"), "")


def _after(array: Column, n: int) -> Column:
    """An array without its first n elements."""
    return F.slice(array, F.lit(n + 1), F.greatest(F.size(array), F.lit(1)))


def _windows(words: Column) -> Column:
    """Every three words in a row."""
    n = F.greatest(F.size(words) - 2, F.lit(0))
    return F.arrays_zip(*[F.slice(words, F.lit(k + 1), n).alias(f"w{k}") for k in range(3)])


def _with_repeat_words(rows: DataFrame, words_name: str) -> DataFrame:
    """Add n_repeat_words: words that lie in a window found twice or more.

    Equal hashes only say which texts are worth a look. There, the windows are sorted by
    their words, so that equal ones are neighbours; the words covered by their positions
    are counted with overlaps counted once. Each step is a column of its own, since an
    expression used twice within another would be computed twice.
    """
    names = [unused(rows, n) for n in ("_hashes", "_ordered", "_places")]
    words, hashes, ordered_, places_ = map(F.col, (words_name, *names))
    hashed = rows.withColumn(
        names[0], F.transform(_windows(words), lambda z: F.xxhash64(z["w0"], z["w1"], z["w2"]))
    )
    at = F.sequence(F.lit(0), F.size(hashes) - 1)
    numbered = F.arrays_zip(hashes.alias("h"), _windows(words).alias("w"), at.alias("at"))
    unique = F.size(F.array_distinct(hashes)) == F.size(hashes)
    # by hash, then words, then position
    ordered = hashed.withColumn(names[1], F.when(~unique, F.sort_array(numbered)))
    twins = F.zip_with(
        ordered_,
        _after(ordered_, 1),
        lambda x, y: F.when((x["h"] == y["h"]) & (x["w"] == y["w"]), F.array(x["at"], y["at"])),
    )
    places = F.flatten(F.filter(twins, lambda t: t.isNotNull()))
    placed = ordered.withColumn(names[2], F.sort_array(F.array_distinct(places)))
    covered = F.zip_with(
        places_,
        _after(places_, 1),
        lambda x, y: F.least(F.lit(3), F.coalesce(y - x, F.lit(3))),
    )
    counted = F.aggregate(covered, F.lit(0).cast("long"), lambda total, x: total + x)
    found = F.coalesce(counted, F.lit(0).cast("long"))
    return placed.withColumn("n_repeat_words", found).drop(*names)


def with_base_rules(docs: DataFrame, text: str = "text", words_name: str = "_words") -> DataFrame:
    """Add the base counts, base_failed, and the words as an array. Columns of the input
    that have the name of a result are replaced."""
    body = whole(text)
    words = docs.withColumn(words_name, words_of(body))
    lines = F.filter(
        F.split(body, "\n"), lambda line: F.length(F.translate(line, SPACES, "")) > 0
    )
    counted = words.withColumns(
        {
            "n_words": F.size(words_name).cast("long"),
            "word_chars": F.length(F.translate(body, SPACES, "")).cast("long"),
            "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        }
    )
    counted = _with_repeat_words(counted, words_name)
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED_PCT * F.col("n_words")
    )
    return counted.withColumn("base_failed", failed)


def _pairs(words: Column) -> Column:
    """Every word with the next one; the last has none."""
    return F.arrays_zip(words.alias("a"), _after(words, 1).alias("b"))


def _buckets(first: Column, second: Column, buckets: int) -> tuple[Column, Column]:
    """The bucket of a word, and of a word with its next, in a range of its own."""
    one = F.pmod(F.xxhash64(first), F.lit(buckets)).cast("int")
    two = F.pmod(F.xxhash64(first, second), F.lit(buckets)).cast("int") + buckets
    return one, two


def trusted_ids(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` ids of documents labelled good and never bad."""
    good = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("good"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    return good.where("good > 0").select("doc_id").orderBy(*order).limit(sample)


def ratios(
    docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, sample: int = SAMPLE,
    prior: float = PRIOR, text: str = "text",
) -> list[float]:
    """The log ratio of trusted to corpus probability of each bucket: words, then pairs."""
    ids = stored(trusted_ids(labels, sample), "quality-trusted")
    # at most ``sample`` ids, so the texts need no shuffle
    texts = docs.select("doc_id", whole(text).alias("text"))
    marked = texts.join(F.broadcast(ids.withColumn("good", F.lit(1))), "doc_id", "left")
    pairs = marked.select("good", F.explode(_pairs(words_of(F.col("text")))).alias("pair"))
    both = F.array(*_buckets(F.col("pair.a"), F.col("pair.b"), buckets))
    counts = (
        pairs.select("good", F.explode(both).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("corpus"), F.count("good").alias("trusted"))
    )
    corpus, trusted = [0] * (2 * buckets), [0] * (2 * buckets)
    for row in counts.collect():  # one row a bucket
        corpus[row["bucket"]], trusted[row["bucket"]] = row["corpus"], row["trusted"]
    if not any(trusted):
        return [0.0] * (2 * buckets)
    # the trusted model leans on the corpus by PRIOR n-grams, so a small sample says little
    shares = [c / sum(corpus) for c in corpus]
    size = sum(trusted)
    return [
        math.log((t + prior * p) / ((size + prior) * p)) if p else 0.0
        for t, p in zip(trusted, shares, strict=True)
    ]


def score(words: Column, table: list[float]) -> Column:
    """Mean log ratio over the words and pairs of an array of words; null if it is empty."""
    buckets = len(table) // 2
    # a constant array by way of text: one value, not one expression a bucket
    constant = F.split(F.lit(",".join(map(repr, table))), ",").cast("array<double>")

    def add(total: Column, pair: Column) -> Column:
        one, two = _buckets(pair["a"], pair["b"], buckets)
        return total + F.get(constant, one) + F.get(constant, two)

    total = F.aggregate(_pairs(words), F.lit(0.0), add)
    return F.when(F.size(words) > 0, total / (2 * F.size(words)))


def rate_documents(
    docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = THRESHOLD, **options
) -> DataFrame:
    """All columns with the base counts, base_failed, ``llr`` and ``kept``."""
    table = ratios(docs, labels, text=text, **options)
    words = unused(docs, "_words")
    counted = with_base_rules(docs, text, words).withColumn("llr", score(F.col(words), table))
    kept = ~F.col("base_failed") & F.coalesce(F.col("llr") >= threshold, F.lit(False))
    return counted.withColumn("kept", kept).drop(words)
