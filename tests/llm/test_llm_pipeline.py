"""Each stage against a plain version of it, on its own input."""

import corpus_pipeline
from test_llm_lines import plain_cut
from test_llm_packing import check_documents, check_places
from test_llm_simhash import plain_components, plain_fingerprint
from test_llm_spans import plain_secrets

import __spark_entry__ as entry_module
from readyscope.llm import linededup, spans
from readyscope.llm.common import stored

NAMES = ["toxicity", "line_dedup", "simhash_near_dedup", "secret_scan", "best_fit_packing"]


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, [texts_of(docs)]
    assert [name for name, _ in corpus_pipeline.STAGES] == NAMES
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir), "test-stage")
        if name != NAMES[-1]:
            assert docs.columns == columns
            assert docs.where("n_chars <> length(text)").isEmpty()
            kept.append(texts_of(docs))
    start, nice, cut, unique, safe = kept
    assert nice.items() <= start.items() and len(nice) > 0.8 * len(start)
    left = dict(plain_cut(sorted(nice.items()), linededup.WINDOW_WORDS))
    assert cut == {i: t for i, t in left.items() if t.strip() or t == nice[i]}
    prints = [(i, plain_fingerprint(t)) for i, t in cut.items()]
    roots = plain_components(prints)
    assert unique == {i: cut[i] for (i, _), root in zip(prints, roots, strict=True) if i == root}
    for i, text in unique.items():
        # the whole text: base spans go, and beside them only what the method adds
        plain = spans.redact(text, plain_secrets(text))
        assert safe[i] == plain or "[RANDOM]" in safe[i]
        if "[RANDOM]" in safe[i]:
            parts = [p for p in safe[i].split("[RANDOM]") if p]
            assert all(p in plain for p in parts)
    rows = docs.collect()
    check_documents(rows, list(safe.items()), 2048)
    check_places(rows, 2048)


def test_run_is_the_registered_query(spark, sf_dir):
    found = entry_module.queries()["pipeline"](spark, sf_dir)
    assert found.count() > 0 and "pipeline" not in entry_module.oracle_sql()


def test_odd_rows(spark, odd, empty, sf_dir):
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, sf_dir), "test-odd")
        assert docs.count() >= 0
