"""Words next to letters outside ASCII: Spark's claims must be those of the SQL beside them."""

import duckdb
from pyspark.sql import functions as F

from hindcast.plans import decision_plans, news_plans, stat_plans
from hindcast.sources import adapters as A

TEXTS = ["éAUX Le ñCI went. Then Paris", "1Foo _Bar -Baz ÉTZ's Ab", "One.\x0bTwo Three. Four", "no names heré", "Ünder ́Abc ١Def", None, ""]


def test_claims_of_texts_outside_ascii(spark, tmp_path):
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, lang VARCHAR, source VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, 'xx', 's', ?)", [[i, t] for i, t in enumerate(TEXTS)])
    db.execute(f"COPY documents TO '{tmp_path}/documents.parquet'")
    want = db.execute(A.duck("articles", "claims") + "SELECT article, claim, entities, family FROM claims ORDER BY article").fetchall()
    found = A.claims(spark, str(tmp_path)).select("article", "claim", "entities", "family").orderBy("article").collect()
    assert [tuple(r) for r in found] == want
    assert found[0]["entities"] == ["AUX", "CI", "Le"]


def test_claims_trim_all_space_separators_and_lower_the_dotted_i(spark, tmp_path):
    texts = ["\u00a0\u3000Foo bar. Baz\u2003", "one\u2003", "\u00a0", "x İone. Two", "9İA?", "\u2028Foo\u2028", "\tFoo\n"]
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, lang VARCHAR, source VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, 'xx', 's', ?)", [[i, t] for i, t in enumerate(texts)])
    db.execute(f"COPY documents TO '{tmp_path}/documents.parquet'")
    want = db.execute(A.duck("articles", "claims") + "SELECT article, claim, list_sort(words) AS words, family FROM claims ORDER BY article").fetchall()
    found = A.claims(spark, str(tmp_path)).select("article", "claim", F.array_sort("words").alias("words"), "family").orderBy("article").collect()
    assert [tuple(r) for r in found] == want
    assert found[0]["claim"] == "Foo bar." and found[3]["words"] == ["ione"]


def _odd_world(folder, documents):
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, lang VARCHAR, source VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, 'xx', ?, ?)", documents)
    db.execute("CREATE TABLE benchmark AS SELECT * FROM (VALUES (1::BIGINT, 'alpha beta gamma. Delta'), (2, 'omega sigma')) t(item_id, text)")
    for t in ("documents", "benchmark"):
        db.execute(f"COPY {t} TO '{folder}/{t}.parquet'")
    return db


def _same_as_sql(spark, folder, db, plans, name):
    found, want = plans.QUERIES[name](spark, str(folder)), db.execute(plans.ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(map(repr, map(tuple, found.select(*columns).collect()))) == sorted(map(repr, want.fetchall())), name


def test_claim_edges_put_missing_ids_last(spark, tmp_path):
    # Only the times of missing ids are null, so no tie is left open.
    db = _odd_world(tmp_path, [[None, "s", "Foo alpha"], [5, "s", "Foo beta"], [6, "r", "Foo gamma"]])
    _same_as_sql(spark, tmp_path, db, stat_plans, "claim_edges")


def test_news_known_leaves_missing_sources_out(spark, tmp_path):
    db = _odd_world(tmp_path, [[1, None, "Foo alpha"], [2, "s", "Bar beta"], [None, None, "Baz gamma"]])
    _same_as_sql(spark, tmp_path, db, news_plans, "news_known")


def test_judgments_of_repeated_ids_keep_texts_without_words(spark, tmp_path):
    db = _odd_world(tmp_path, [[1, "s", "Foo alpha beta"], [1, "s", "..."], [2, "s", "Foo omega"]])
    for name in ("judgments_in_force", "news_targets", "rescore_news"):
        _same_as_sql(spark, tmp_path, db, news_plans, name)


def test_relevance_of_repeated_ids_takes_the_least_family(spark, tmp_path):
    db = _odd_world(tmp_path, [[i, "s", text] for i in range(1, 9) for text in (("Zeta alpha", "Abc beta"), ("Abc alpha", "Zeta beta"))[i % 2]])
    for name in ("relevance_snapshot", "features_news", "features_decay"):
        _same_as_sql(spark, tmp_path, db, decision_plans, name)
