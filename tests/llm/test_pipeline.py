import corpus_pipeline
from corpus_pipeline import STAGES, run

from .fixtures import odd_texts

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        got = {r.doc_id: r.text for r in out.collect()}
        assert set(got) <= ids
        if name == "quality rules":
            lost = [i for i in ids - set(got) if i in labels and labels[i].quality == 1]
            assert len(lost) <= 0.1 * len(labels)


def test_run_packs_what_is_left(spark):
    rows = run(spark, SF).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 2048


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_odd_documents_and_none(spark):
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in odd_texts()], SCHEMA)
    rows = sorted(map(tuple, docs.collect()), key=str)
    stage = dict(STAGES)
    assert sorted(map(tuple, stage["toxicity"](spark, docs, SF).collect()), key=str) == rows  # no telling words
    good = [r[:2] for r in stage["quality rules"](spark, docs, SF).collect()]
    assert good == [(6, dict(odd_texts())[6])]  # the only one of 50 words
    left = sorted((r[:2] for r in stage["n-gram Jaccard join"](spark, docs, SF).collect()), key=str)
    want = [(i, t) for i, t in odd_texts() if i not in (5, 9)] + [(9, "x" * 5000)]
    assert left == sorted(want, key=str)
    assert sorted(r[:2] for r in stage["substring dedup"](spark, docs.where("doc_id in (4, 9)"), SF).collect()) == sorted((i, t) for i, t in odd_texts() if i in (4, 9))
    packed = stage["best-fit packing"](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in odd_texts()}
    none = spark.createDataFrame([], SCHEMA)
    for _, apply in STAGES:
        assert apply(spark, none, SF).count() == 0
    assert corpus_pipeline.ORACLE_SQL is None


def words(name, n=60):
    return " ".join(f"{name}{i}" for i in range(n))


def test_near_duplicates_go_by_row(spark):
    a, b, c = words("a"), words("b"), words("c")
    rows = [(1, a, 1), (2, a, 2), (2, b, 3), (3, c, 4), (3, c, 4), (None, a, 5), (None, words("n"), 6), (4, b + " tail", 7), (5, words("alone"), 8), (None, None, 9), (None, None, 9)]
    docs = spark.createDataFrame([(i, t, None, None, None, k, i, 0) for i, t, k in rows], SCHEMA + ", row_key bigint, kept bigint, n bigint")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text, r.row_key) for r in out.collect()), key=str)
    stay = [rows[0], rows[2], rows[3], rows[6], rows[8], rows[9], rows[10]]
    assert got == sorted(stay, key=str)


def test_low_quality_goes_by_row(spark):
    good = " ".join(f"word{i} goes" if i % 9 else f"word{i} goes.\n" for i in range(150))
    rows = [(1, good, 1), (1, "too short", 2), (None, good, 3), (None, "short too", 4), (2, None, 5), (2, good, 6), (2, good, 6)]
    docs = spark.createDataFrame([(i, t, None, None, None, k, 0) for i, t, k in rows], SCHEMA + ", row_key bigint, quality bigint")
    out = corpus_pipeline.drop_low_quality(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted((r.row_key for r in out.collect())) == [1, 3, 6, 6]
