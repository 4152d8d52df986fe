import random

import pytest

from readyscope.llm import linededup, registry


def plain_windows(lines, window_words):
    """(first, end) of the least runs of lines with that many words, from a line on or up to it."""
    found, n = set(), len(lines)
    for at in range(n):
        for step in (1, -1):
            words, b = 0, at
            while 0 <= b < n and words < window_words:
                words += len(lines[b][2])
                b += step
            if words >= window_words:
                found.add((at, b) if step == 1 else (b + 1, at + 1))
    return sorted(found)


def plain_cut(docs, window_words):
    """Every window by its words; what came earlier in (id, place) is cut, by characters.

    ``every_run_cut`` below, which tries runs of every length, comes to the same.
    """
    first, cuts = {}, {}
    for key, text in sorted(set(docs), key=lambda d: (d[0] is None, d[0] or 0)):
        lines = list(linededup.lines_of(text or ""))
        for a, b in plain_windows(lines, window_words):
            window = tuple(tuple(line[2]) for line in lines[a:b])
            place = (key, text, lines[a][0], lines[b - 1][1])
            source = first.setdefault(window, place)
            if source != place:
                start = max(place[2], source[3]) if source[:2] == place[:2] else place[2]
                cuts.setdefault((key, text), []).append((start, place[3]))
    out = []
    for key, text in docs:
        keep = [True] * len(text or "")
        for start, end in cuts.get((key, text), []):
            keep[start:end] = [False] * max(0, end - start)
        out.append((key, text and "".join(c for c, k in zip(text, keep, strict=True) if k)))
    return out


def compare(spark, docs, window_words):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = linededup.without_repeats(df, window_words=window_words).collect()
    wanted = plain_cut(docs, window_words)
    assert sorted(((r["doc_id"], r["text"]) for r in found), key=repr) == sorted(wanted, key=repr)
    for r in found:
        assert (r["cut_spans"] is None) == ((r["doc_id"], r["text"]) in docs)


@pytest.mark.parametrize("window_words", [1, 3, 8])
def test_random_documents(spark, window_words):
    """Few lines in random order: runs of every length, ties, periods, runs within a text."""
    rng = random.Random(window_words)
    lines = ["a b.", "c d e.", "f.", "g h", "a b.", "i j k l!", "m?"]
    docs = []
    for i in range(60):
        text = "".join(rng.choice(lines) + rng.choice([" ", "\n", "\n\n "]) for _ in range(rng.randint(0, 14)))
        docs.append((i, text))
    docs += [(70, "f. " * 40), (71, "f. " * 40), (72, "a b. c d e. " * 20)]
    compare(spark, docs, window_words)


def test_query_equals_plain_version(spark, sf_dir, texts):
    rows = registry.queries()["op1_line_dedup"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    wanted = dict(plain_cut(texts, linededup.WINDOW_WORDS))
    assert {r["doc_id"]: r["text"] for r in rows} == wanted
    assert any(r["n_cut"] for r in rows)


def test_passage_inside_a_paragraph(spark):
    rng = random.Random(3)

    def sentence(n):
        return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) + "."

    passage = " ".join(sentence(11) for _ in range(5))
    docs = [(i, f"{sentence(9)} {sentence(12)} {passage} {sentence(10)}\n{sentence(8)}") for i in range(30)]
    clean = [(100 + i, " ".join(sentence(10) for _ in range(9))) for i in range(20)]
    df = spark.createDataFrame(docs + clean, "doc_id long, text string")
    found = {r["doc_id"]: r["text"] for r in linededup.drop_repeats(df).collect()}
    assert passage in found[0]
    assert not any(passage[:20] in found[i] for i in range(1, 30))
    assert all(found[i] == t for i, t in clean)
    assert all(t.split(passage)[0] in found[i] and t.split(passage)[1].strip() in found[i] for i, t in docs)


def test_every_repeated_run_has_a_common_fingerprint():
    """The guarantee of winnowing, for the windows of one text inside two others."""
    rng = random.Random(7)
    for _ in range(50):
        run = [f"{rng.randrange(10**6)} {rng.randrange(10**6)}." for _ in range(6)]
        around = [[f"{rng.randrange(10**6)}." for _ in range(rng.randint(0, 9))] for _ in range(4)]
        texts = [" ".join(around[0] + run + around[1]), " ".join(around[2] + run + around[3])]
        chosen = []
        for text in texts:
            lines = linededup._Lines([text])
            _, _, selected, _ = linededup.windows(lines, 8)
            chosen.append({int(lines.hashes[i]) for i in selected})
        own = {linededup._hash(line.split()) for line in run}
        assert chosen[0] & chosen[1] & own


def test_odd_rows(odd, empty, odd_rows):
    found = linededup.without_repeats(odd).drop("cut_spans")
    assert sorted(((r["doc_id"], r["text"]) for r in found.collect()), key=repr) == sorted(
        plain_cut(odd_rows, linededup.WINDOW_WORDS), key=repr
    )
    kept = linededup.drop_repeats(odd)
    assert kept.columns == odd.columns and kept.count() == len(odd_rows)
    assert all(r["cut_spans"] == "x" for r in kept.collect())
    assert linededup.drop_repeats(empty).count() == 0


def test_copies_go_and_repeated_rows_stay(spark):
    text = "one two three four five. six seven eight nine ten."
    docs = [(1, text), (1, text), (2, text), (3, text + " And more."), (None, text)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = sorted(((r["doc_id"], r["text"]) for r in linededup.drop_repeats(df, window_words=5).collect()), key=repr)
    assert found == [(1, text), (1, text), (3, "And more.")]


def every_run_cut(docs, window_words):
    """Every run of whole lines with that many words, however long, by its words."""
    first, runs = {}, []
    for key, text in sorted(docs):
        lines = list(linededup.lines_of(text))
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                words = tuple(tuple(line[2]) for line in lines[a:b])
                if sum(map(len, words)) >= window_words:
                    place = (key, lines[a][0], lines[b - 1][1])
                    runs.append((first.setdefault(words, place), place))
    keep = {key: [True] * len(text) for key, text in docs}
    for (source, _, end), (key, start, stop) in runs:
        if (source, end) != (key, stop):
            for i in range(max(start, end) if source == key else start, stop):
                keep[key][i] = False
    return {key: "".join(c for c, k in zip(text, keep[key], strict=True) if k) for key, text in docs}


@pytest.mark.parametrize("window_words", [3, 8, 25])
def test_whole_runs_of_mixed_sentences_are_cut(spark, window_words):
    rng = random.Random(window_words)
    lines = [" ".join(f"w{k}x{i}" for i in range(n)) + "." for k, n in enumerate([1, 2, 3, 5, 8, 13, 14, 20, 30])]
    docs = [(i, " ".join(rng.choices(lines, k=rng.randint(0, 9)))) for i in range(80)]
    docs += [(90, f"{lines[0]} " * 40), (91, f"{lines[1]} " * 40)]
    found = linededup.without_repeats(spark.createDataFrame(docs, "doc_id long, text string"), window_words=window_words)
    assert {r["doc_id"]: r["text"] for r in found.collect()} == every_run_cut(docs, window_words)


def test_exact_copies_with_a_short_end_go(spark):
    text = " ".join(" ".join(f"w{k}x{i}" for i in range(n)) + "." for k, n in enumerate([14, 13, 8]))
    df = spark.createDataFrame([(i, text) for i in range(5)], "doc_id long, text string")
    assert [(r["doc_id"], r["text"]) for r in linededup.drop_repeats(df).collect()] == [(0, text)]
