import corpus_pipeline
from tessera.llm.quality_rules import quality_rules

from .fixtures import WORD, awkward, docs, prose, table_docs


def test_stages_keep_the_columns(spark, sf):
    d = table_docs(spark, sf)
    kept = d
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, sf)
        assert out.columns == d.columns and out.dtypes == d.dtypes, name
        kept = corpus_pipeline.written(out, "test")
    last = corpus_pipeline.STAGES[-1][1](spark, kept, sf)
    assert {r.doc_id for r in last.collect()} == {r.doc_id for r in kept.collect()}


def test_each_stage_does_its_work(spark, sf):
    clean = [prose(i, 80) for i in range(30)]
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    words = clean[0].split()
    near = " ".join(words[:40] + ["changed"] + words[41:])
    texts = [*clean, near, clean[1], prose(50, 60) + " " + item + " " + prose(51, 60), "few words", " ".join(["again and again we say it"] * 40)]
    d = docs(spark, texts)
    stage = {n: f for n, f in corpus_pipeline.STAGES}
    ids = lambda df: {r.doc_id for r in df.collect()}
    every = set(range(len(texts)))
    assert ids(stage["quality_rules"](spark, d, sf)) == ids(quality_rules(d).filter("kept")) and not {33, 34} & ids(stage["quality_rules"](spark, d, sf))
    assert set(range(30)) <= ids(stage["quality_rules"](spark, d, sf))
    assert every - ids(stage["simhash_near_dedup"](spark, d, sf)) == {30, 31}
    assert every - ids(stage["decontamination"](spark, d, sf)) == {32}
    assert every - ids(stage["line_dedup"](spark, d, sf)) == {31}


def test_run_ends_with_every_document_encoded(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    rows = out.collect()
    assert rows and all(r.round_trip and r.n_pieces >= r.n_segments > 0 for r in rows)
    kept = {r.doc_id: r.text for r in table_docs(spark, sf).collect()}
    assert all(WORD.search(kept[r.doc_id]) for r in rows)


def test_empty_and_awkward_tables(spark, sf):
    for d in (docs(spark, []), docs(spark, awkward())):
        for name, stage in corpus_pipeline.STAGES:
            assert stage(spark, d, sf).count() <= d.count(), name
