import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from readyscope.llm import phrases, registry


def plain_lists(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lowered)]


def plain_collocations(docs, min_count, top=2000, max_words=5):
    """Every phrase of every piece, by the wording of the contract."""
    counts, words = defaultdict(Counter), Counter()
    for _, text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in plain_lists(text):
            words[lang] += len(piece)
            for n in range(1, max_words + 1):
                counts[lang].update(tuple(piece[i : i + n]) for i in range(len(piece) - n + 1))
    found = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        rows = []
        for p, a in candidates.items():
            longer = [
                b for q, b in candidates.items()
                if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            ]
            if any(100 * b >= 100 * a for b in longer):
                continue
            score, _, left, right = min(
                (1000 * a * words[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))
            )
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            found.append((lang, rank, phrase.decode(), -a, left, right, words[lang], -score))
    return sorted(found)


def plain_counts(texts):
    wanted = Counter()
    for text in texts:
        for piece in plain_lists(text.decode()):
            wanted.update(" ".join(piece[i : i + n]) for n in range(1, 6) for i in range(len(piece) - n + 1))
    return wanted


def corpus(rng, n, words=12):
    known = [f"w{i}" for i in range(words)] + ["É", "B", "日本"]
    weights = [1 / (i + 1) for i in range(len(known))]
    docs = []
    for i in range(n):
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n"]) for w in rng.choices(known, weights, k=rng.randint(0, 60)))
        docs.append((i, text, rng.choice(["en", "en", "de", None])))
    return docs


def mined(spark, docs, **options):
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    return sorted(tuple(r) for r in phrases.collocations(df, **options).collect())


@pytest.mark.parametrize(("min_count", "every"), [(3, 1), (8, 4), (20, 1000)])
def test_equals_counting_everything(spark, min_count, every):
    """The sample may be all, a part or next to nothing of the documents: same rows."""
    docs = corpus(random.Random(min_count), 150)
    docs += [(900 + i, "planted phrase of five words", "en") for i in range(25)] + [(1, "a a a a a a a", "de")] * 9
    wanted = plain_collocations(docs, min_count)
    assert mined(spark, docs, min_count=min_count, every=every) == wanted
    assert any(r[2] == "planted phrase of five words" for r in wanted)


def test_border_failures_are_made_good(spark, monkeypatch):
    """Nothing is proposed at all: each pass finds phrases one word longer, until closed."""
    passes = []
    whole = phrases.count_hashes
    monkeypatch.setattr(phrases, "propose", lambda *a, **k: phrases.Bitmap.empty())
    monkeypatch.setattr(phrases, "count_hashes", lambda *a, **k: passes.append(1) or whole(*a, **k))
    docs = corpus(random.Random(7), 80) + [(900 + i, "one two three four five six", "en") for i in range(30)]
    monkeypatch.setattr(phrases, "OFTEN", 0.01)
    assert mined(spark, docs, min_count=25) == plain_collocations(docs, 25)
    assert len(passes) == 5
    # with what is often in a slice proposed too, the second pass closes
    passes.clear()
    monkeypatch.setattr(phrases, "OFTEN", 4)
    assert mined(spark, docs, min_count=25) == plain_collocations(docs, 25)
    assert len(passes) == 2


def test_one_pass_makes_up_for_a_few_misses(spark, monkeypatch):
    """A phrase and all that begins with it are not proposed: found in one further pass."""
    passes = []
    propose, whole = phrases.propose, phrases.count_hashes

    def without_some(*args, **options):
        found = propose(*args, **options)
        words = phrases.Words([b"one", b"two", b"three", b"four"], "en").hashes
        phrase = words[:1]
        for n in (2, 3, 4):
            phrase = phrases._mixed(phrase, words[n - 1 : n], n)
            bit = int(phrase[0]) >> 3 & phrases.BITMAP_BITS - 1
            assert found.has(phrase)[0]
            found.words[bit // 64] &= ~np.uint64(1 << bit % 64)
        passes.clear()
        return found

    monkeypatch.setattr(phrases, "propose", without_some)
    monkeypatch.setattr(phrases, "count_hashes", lambda *a, **k: passes.append(1) or whole(*a, **k))
    monkeypatch.setattr(phrases, "OFTEN", 0.01)
    docs = corpus(random.Random(7), 80) + [(900 + i, "one two three four five six", "en") for i in range(30)]
    wanted = plain_collocations(docs, 25)
    assert any(r[2] == "one two three four five" for r in wanted)
    assert mined(spark, docs, min_count=25, every=1) == wanted
    assert len(passes) == 2


@pytest.mark.parametrize("most", [1, 50, 10**6])
def test_a_task_adds_up_its_slices(spark, most):
    """Exact counts leave a task once for each phrase, or in parts where it holds fewer."""
    texts = [t.encode() for _, t, _ in corpus(random.Random(3), 60)]
    every = phrases.Bitmap(np.full(phrases.BITMAP_BITS // 64, 2**64 - 1, np.uint64))
    docs = spark.createDataFrame([("en", t) for t in texts], "lang string, text binary").coalesce(1)
    rows = phrases.count_phrases(docs, 5, every, size=100, most=most).collect()
    found = Counter()
    for lang, _, phrase, n in rows:
        found[phrase] += n
    total = found.pop(None)
    wanted = plain_counts(texts)
    assert found == wanted and total == sum(n for p, n in wanted.items() if " " not in p)
    if most == 10**6:
        assert len(rows) == len(wanted) + 1


def test_hashes_that_meet_change_nothing(spark, monkeypatch):
    """Hashes of a few bits: many phrases share one, in a slice and beyond it."""
    monkeypatch.setattr(phrases, "_marked", lambda h, n: h & np.uint64(0x1F8) | np.uint64(n))
    docs = corpus(random.Random(9), 60)
    texts = [t.encode() for _, t, _ in docs]
    every = phrases.Bitmap(np.full(phrases.BITMAP_BITS // 64, 2**64 - 1, np.uint64))
    found = Counter()
    for words, carried in phrases.word_lists(texts, 5):
        for _, some, counts in phrases.exact_counts(words, carried, "en", 5, every):
            found.update(dict(zip([s.decode() for s in some], counts.tolist(), strict=True)))
    assert found == plain_counts(texts)


def test_phrases_are_told_once_whatever_the_tasks(spark, monkeypatch):
    """No pass hands on each frequent phrase from every task that has met it."""
    told, counted = [], []
    tell, count = phrases.told, phrases.count_phrases
    monkeypatch.setattr(phrases, "told", lambda *a: told.append(tell(*a)) or told[-1])
    monkeypatch.setattr(phrases, "count_phrases", lambda *a, **k: counted.append(count(*a, **k)) or counted[-1])
    docs = corpus(random.Random(5), 240)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(12)
    rows = phrases.collocations(df, min_count=20, every=2).collect()
    assert sorted(map(tuple, rows)) == plain_collocations(docs, 20)
    frequent = sum(df.where("phrase is not null").count() for df in told)
    assert frequent == sum(df.where("phrase is not null").select("lang", "phrase").distinct().count() for df in told) > 100
    assert sum(df.where("n_words > 1").count() for df in counted) == 0


@pytest.mark.parametrize("most", [0, 1, 3, 9])
def test_words_without_a_number_change_nothing(spark, monkeypatch, most):
    """A phrase is counted by its text if any of its words has no number."""
    monkeypatch.setattr(phrases, "MOST_KNOWN", most)
    docs = corpus(random.Random(11), 120)
    assert mined(spark, docs, min_count=10, every=1) == plain_collocations(docs, 10)


def test_keys_stand_for_one_phrase_each():
    """Numbers of one and two bytes, other languages and unknown words: keys tell the phrase."""
    pairs = [("en", f"w{i}".encode()) for i in range(60_000)] + [("de", b"w1"), ("de", "ß".encode())]
    known = phrases.Known(pairs)
    texts = {"en": b"w1 w255 w256 w59999 w0 new w1 w2", "de": "w1 ß w1 w2 日本 w1 ß".encode()}
    found = set()
    for lang, text in texts.items():
        words = phrases.Words(text.split(), lang)
        own = known.in_list(words, lang)
        for n in range(1, 6):
            begins = np.arange(len(words.words) - n + 1)
            keys, order = known.keys(words, own, lang, n, begins)
            for key, at in zip(keys.to_pylist(), order.tolist(), strict=True):
                assert known.phrase(key) == (lang, words.words[at : at + n])
                found.add((key, lang, b" ".join(words.words[at : at + n])))
    assert len({key for key, _, _ in found}) == len(found) == len({p[1:] for p in found})


def test_a_crowded_bitmap_changes_nothing(spark, monkeypatch):
    """Far more phrases than bits: everything is counted, results stay."""
    monkeypatch.setattr(phrases, "BITMAP_BITS", 64)
    docs = corpus(random.Random(8), 60)
    assert mined(spark, docs, min_count=5, every=2) == plain_collocations(docs, 5)


@pytest.mark.parametrize("size", [1, 7, 40, 10_000])
def test_slices_lose_no_phrase(size):
    """Texts longer than a slice are cut; every phrase still counts once."""
    rng = random.Random(size)
    texts = [t.encode() for _, t, _ in corpus(rng, 30)] + [b"", b"x" * 200, b" a b  c. d " * 20]
    every = phrases.Bitmap(np.full(phrases.BITMAP_BITS // 64, 2**64 - 1, np.uint64))
    found, total = Counter(), 0
    for words, carried in phrases.word_lists(texts, 5, size):
        total += sum(w != b"\xff" for w in words[carried:])
        for _, some, counts in phrases.exact_counts(words, carried, "en", 5, every):
            found.update(dict(zip([s.decode() for s in some], counts.tolist(), strict=True)))
    wanted = plain_counts(texts)
    assert found == wanted and total == sum(n for p, n in wanted.items() if " " not in p)


def test_products_beyond_64_bits(spark):
    counts = [("en", 1, "a", 3 * 10**12), ("en", 1, "b", 7 * 10**12), ("en", 2, "a b", 2 * 10**12 + 1)]
    df = spark.createDataFrame(counts, "lang string, n_words int, phrase string, n long")
    words = spark.createDataFrame([("en", 9 * 10**15)], "lang string, words long")
    row = phrases.scored_phrases(df, words).first()
    assert row["score"] == 1000 * (2 * 10**12 + 1) * 9 * 10**15 // (21 * 10**24)


def test_query_equals_its_sql(spark, sf_dir):
    found = registry.queries()["op13_collocations"](spark, sf_dir)
    wanted = duckdb.sql(phrases.ORACLE.replace("FROM documents", f"FROM '{sf_dir}/documents.parquet'")).fetchall()
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == sorted(wanted) and len(wanted) > 20


def test_odd_rows(spark, odd, empty, odd_rows):
    from pyspark.sql import functions as F

    docs = [(i, t, None) for i, t in odd_rows]
    rows = phrases.collocations(odd.withColumn("lang", F.lit(None).cast("string")), min_count=2).collect()
    assert sorted(map(tuple, rows)) == plain_collocations(docs, 2)
    assert phrases.collocations(empty.withColumn("lang", F.lit("en"))).count() == 0
