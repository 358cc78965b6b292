import corpus_pipeline as P
from pyspark.sql import functions as F

from strataloom.llm.simhash import near_duplicate_groups

from .corpora import empty, near_copies, odd, odd_rows

FORM = "doc_id long, text string, lang string, source string, n_chars long"


def as_documents(spark, rows):
    return spark.createDataFrame([(d, t, "en", "web", len(t)) for d, t in rows], FORM)


def test_stages_one_by_one(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select(*P.COLUMNS)
    for name, stage in P.STAGES[:-1]:
        got = P.stored(stage(spark, docs, small), name)
        assert got.columns == P.COLUMNS and got.dtypes == docs.dtypes
        assert 0.6 * docs.count() < got.count() <= docs.count()
        if name != "personal_data":
            assert got.exceptAll(docs).isEmpty()
        if name == "near_duplicates":
            groups = near_duplicate_groups(docs)
            assert got.count() == groups.select("group_id").distinct().count()
            assert got.join(groups, "doc_id").groupBy("group_id").count().where("count > 1").isEmpty()
        docs = got
    assert P.packing(spark, docs, small).select(F.sum("length")).first()[0] > 0


def test_one_of_each_family_stays(spark, small):
    rows, family = near_copies()
    got = {r.doc_id for r in P.near_duplicates(spark, as_documents(spark, rows), small).collect()}
    assert got == {min(d for d in family if family[d] == f) for f in set(family.values())}


def test_personal_data_is_masked(spark, small):
    rows = [(1, "write to a.b@c.org or 10.0.0.1 now"), (2, "nothing here"), (3, "")]
    got = {r.doc_id: r for r in P.personal_data(spark, as_documents(spark, rows), small).collect()}
    assert got[1].text == "write to <email> or <ip> now" and got[1].n_chars == len(got[1].text)
    assert got[2].text == "nothing here" and got[3].text == ""


def test_odd_and_empty_tables(spark, small):
    for docs, n in ((odd(spark), len(odd_rows())), (empty(spark), 0)):
        docs = docs.select(*P.COLUMNS)
        for _, stage in P.STAGES:
            docs = P.stored(stage(spark, docs, small), "odd")
        assert docs.count() <= 40 * n and (docs.count() > 0) == (n > 0)


def test_the_driver_gives_memory_back_before_each_stage(spark, tiny, monkeypatch):
    done, trimmed = [], P.trimmed
    monkeypatch.setattr(P, "trimmed", lambda s: done.append(trimmed(s)))
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select(*P.COLUMNS)
    for _, stage in P.STAGES:
        stage(spark, docs.limit(5), tiny)
    assert done == [True] * len(P.STAGES)  # Linux, JDK 17.0.9 or later


def test_run_gives_the_last_stage(spark, tiny):
    got = P.run(spark, tiny)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(got.columns) and got.count() > 0
