from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from hindcast.llm.oracle import ORACLE
from tests.llm import helpers as H

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
def test_pipeline_equals_brute_force(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
    docs = db.execute(f"SELECT doc_id, text, lang, source, n_chars FROM '{SF}/documents.parquet'").df()

    def over(name):
        db.register("documents", docs)
        return db.execute(ORACLE[name]).df()

    good = over("op8_quality_rules")
    docs = docs[docs.doc_id.isin(good[good.kept].doc_id)]
    clean = H.line_windows(list(zip(docs.doc_id, docs.text, strict=True)))
    docs = docs.assign(text=[clean[i] for i in docs.doc_id])
    docs = docs[[bool(H.SPACE.search(t)) or t == o for t, o in zip(docs.text, docs.text, strict=True)]]
    docs = docs[docs.text.map(lambda t: bool(H.SPACE.search(t)))].sort_values("doc_id")
    first = H.groups([H.simhash(t) for t in docs.text])
    docs = docs[[g == i for i, g in enumerate(first)]]
    leaked = over("op2_decontamination")
    docs = docs[~docs.doc_id.isin(leaked[leaked.contaminated].doc_id)]
    mixed = over("op9_mixing")
    want = sorted((int(r.doc_id), int(r.size_), int(r.taken)) for r in mixed.rename(columns={"size": "size_"}).itertuples() if r.taken > 0)
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "source_size", "target", "taken"]
    assert sorted((r.doc_id, r["size"], r.taken) for r in out.collect()) == want


def test_stages_keep_the_columns(spark):
    docs = H.docs(spark, [(1, "word " * 60), (2, None)])
    for _, stage in corpus_pipeline.STAGES[:2]:
        assert stage(spark, docs, SF).columns == docs.columns
