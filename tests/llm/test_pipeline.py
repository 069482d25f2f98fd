import corpus_pipeline
from pyspark.sql import functions as F

from terrakey.llm import registry

DATA = "/root/testdata/sf0.01"


def test_stages_take_effect_and_keep_the_rest(spark):
    """Each stage is held against its own operator's verdicts on its own input."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = {r.doc_id: r for r in docs.collect()}
    kept = {r.doc_id for r in registry.QUERIES["op1_quality_rules"](spark, DATA).where("kept").collect()}
    stages = dict(corpus_pipeline.STAGES)
    one = stages["quality_rules"](spark, docs, DATA).cache()
    assert {r.doc_id for r in one.collect()} == kept and one.columns == docs.columns
    from tests.llm.test_near_dedup import brute

    two = stages["near_dedup"](spark, one, DATA).cache()
    firsts = {c for _, _, c, _ in brute([(i, seen[i].text) for i in kept], 5)}
    assert {r.doc_id for r in two.collect()} == firsts
    three = stages["decontamination"](spark, two, DATA).cache()
    bad = {r.doc_id for r in registry.QUERIES["op6_decontamination"](spark, DATA).collect()}
    assert {r.doc_id for r in three.collect()} == firsts - bad
    four = stages["secret_scans"](spark, three, DATA).cache()
    changed = four.collect()
    assert {r.doc_id for r in changed} == firsts - bad
    for r in changed:
        assert r.n_chars == len(r.text) and ((r.text == seen[r.doc_id].text) or "[secret]" in r.text)
    packed = stages["best_fit_packing"](spark, four, DATA).select("doc_id", "piece", "start", "length", "ids_crc32")
    whole = corpus_pipeline.run(spark, DATA).select("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, packed.collect()))


def test_edges(spark):
    rows = [(1, None, None, None, None), (None, "same text here", None, "s", 1), (2, "", "en", "s", 0), (3, "w " * 400, "en", None, 9), (4, " ".join(f"w{i}" for i in range(200)), "en", "s", 9), (4, " ".join(f"w{i}" for i in range(200)), "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("key", F.lit("x"))
    for d in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, d, DATA).columns == corpus_pipeline.COLUMNS
            stage(spark, d, DATA).collect()
    kept = corpus_pipeline.near_dedup(spark, docs, DATA).collect()
    assert sorted(map(str, kept)) == sorted(map(str, docs.select(corpus_pipeline.COLUMNS).distinct().collect()))


def test_near_dedup_keeps_one_row_of_each_group_and_every_other_text(spark):
    """Ids that stand for several texts, null ids and repeated rows."""
    t, u, v, w = (" ".join(f"{c}{i}" for i in range(60)) for c in "tuvw")
    rows = [(1, t, "a"), (4, t, "a"), (4, u, "b"), (4, u, "a"), (4, u, "a"), (None, v, "a"), (None, v, "a"), (None, u + " x", "a"), (None, w, None), (None, w, "a"), (7, None, "a"), (7, None, "a"), (8, " ", "a")]
    docs = spark.createDataFrame([(i, x, "en", s, 1) for i, x, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text, r.source) for r in corpus_pipeline.near_dedup(spark, docs, DATA).collect()), key=str)
    want = [(1, t, "a"), (4, u, "a"), (None, v, "a"), (None, w, None), (7, None, "a"), (7, None, "a"), (8, " ", "a")]
    assert got == sorted(want, key=str)
