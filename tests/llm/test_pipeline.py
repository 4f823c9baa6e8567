"""The pipeline: its stages in order, and what each keeps."""

import corpus_pipeline
from railpulse.llm import decontam, lines, simhash, toxicity

FOLDER = "/root/testdata/sf0.001"


def test_pipeline_equals_its_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels, items = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("labels", "benchmark"))
    scores = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    rest = docs.where(docs.doc_id.isin([i for i, s in scores.items() if s < 0.5]))
    dropped = lines.drop_recurring_lines(rest)
    emptied = {r.doc_id for r in dropped.collect() if r._ld_dropped and not r.text.strip()}
    rest = dropped.where(~dropped.doc_id.isin(list(emptied))).select(*docs.columns)
    groups = simhash.near_duplicates(rest).collect()
    rest = rest.where(rest.doc_id.isin([r.doc_id for r in groups if r.doc_id == r.component_id]))
    bad = {r.doc_id for r in decontam.report(rest, items).collect() if r.contaminated}
    expected = {r.doc_id for r in rest.collect()} - bad
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted(r.doc_id for r in got) == sorted(expected)
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line dedup", "simhash near-dedup", "benchmark decontamination", "source mix"
    ]
    total = sum(r.size for r in got)
    assert abs(sum(r.taken for r in got) - total) < 0.02 * total
