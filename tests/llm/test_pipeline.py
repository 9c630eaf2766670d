import corpus_pipeline
from webloom.llm import secrets

DATA = "/root/testdata/sf0.01"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    planted = "Plain words about a river and the boats that cross it every morning in fog. " * 12
    more = spark.createDataFrame([(10**6, planted, "en", "s", len(planted)), (10**6 + 1, planted + "Once.", "en", "s", len(planted) + 5), (10**6 + 2, "token: abcdefgh12345 and words that follow it here", "en", "s", 50)], docs.schema)
    rows = docs.unionByName(more)
    (_, one), (_, two), (_, three), (_, four) = corpus_pipeline.STAGES
    good = one(spark, rows, DATA)
    assert good.columns == docs.columns and 0.7 * rows.count() < good.count() < rows.count()
    unique = two(spark, rows, DATA)
    ids = {r["doc_id"] for r in unique.collect()}
    assert unique.columns == docs.columns and 10**6 in ids and 10**6 + 1 not in ids and len(ids) < rows.count()
    clean = three(spark, rows, DATA)
    redacted = clean.where(f"doc_id = {10**6 + 2}").first()
    assert clean.columns == docs.columns and clean.count() == rows.count() and redacted["text"].startswith("[SECRET] and") and redacted["n_chars"] == len(redacted["text"])
    packed = four(spark, rows, DATA)
    assert packed.select("doc_id").distinct().count() == rows.select("doc_id").distinct().count()


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0
    assert secrets.KINDS[:3] == ("assign", "access", "hex")


def test_stages_take_odd_tables(spark):
    """Nulls, empty and repeated texts and rows, clashing names, no n_chars, no rows."""
    from conftest_texts import IDS, TEXTS

    schema = "doc_id bigint, text string, score double, `row` string, name string, spans string, digest string, root string, nth int, place int, lang string"
    rows = [(i, t, 0.5, "r", "n", "s", "d", "o", 7, 8, None) for i, t in zip(IDS, TEXTS)] + [(None, None, None, None, None, None, None, None, None, None, None)] * 2
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, DATA)
        assert found.columns == docs.columns
        for r in found.collect():
            assert (r["score"], r["row"], r["nth"]) in ((0.5, "r", 7), (None, None, None))
        assert stage(spark, docs.limit(0), DATA).count() == 0
    unique = corpus_pipeline.STAGES[1][1](spark, docs, DATA)
    # The five texts without words are one group (smallest id 2), the four cats another.
    assert sorted((r["doc_id"] for r in unique.collect())) == [1, 2, 5, 6, 7, 8]
    assert corpus_pipeline.STAGES[2][1](spark, docs, DATA).count() == len(rows)
    packed = corpus_pipeline.STAGES[3][1](spark, docs, DATA)
    assert packed.select("doc_id").distinct().count() == len(set(IDS)) and corpus_pipeline.STAGES[3][1](spark, docs.limit(0), DATA).count() == 0
