"""Bounds of the fitting samples hold for rows, and no learned value is lost by them."""

import pytest

from labelwright.llm import common, cotrain, langid, toxicity


@pytest.fixture
def repeated(spark):
    """One id on 5000 rows with different texts, and some other documents."""
    rows = [(1, f"the same id again number {i}", "en") for i in range(5000)] + [(2 + i, f"other words {i} here", "en") for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_rows_are_bounded_and_rare_languages_kept(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "fit", lambda rows, idf: seen.append(rows))
    rows = [(i % 700, f"the and of {i}", "en") for i in range(5000)] + [(9001, "der die das", "de"), (9001, "der die das", "de"), (9002, "le la les", "fr")]
    langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_rows=20)
    assert len(seen[0]) == 20 and set(seen[0]["lang"]) == {"en", "de", "fr"}
    assert not seen[0].duplicated(["doc", "lang"]).any()


def test_rare_language_is_predicted(spark):
    rows = [(i, f"the and of to is not that with from {i}", "en") for i in range(3000)] + [(9000 + i, f"der die das und ist nicht {i}", "de") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, max_rows=200)
    assert model.langs == ["de", "en"]
    assert model.predict("the of that")[0] == "en" and model.predict("und ist nicht das")[0] == "de"


def test_toxicity_rows_are_bounded(spark, repeated, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda rows, prior: seen.append(rows))
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "doc_id long, toxic int")
    toxicity.train(repeated, labels, max_toxic=10, max_unlabelled=10)
    assert len(seen[0]) == 12 and not seen[0]["doc"].duplicated().any()


def test_quality_rows_are_bounded(spark, repeated, monkeypatch):
    seen = []
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0)], "doc_id long, quality int")
    monkeypatch.setattr(cotrain, "CoTrained", lambda a, b, y, held: seen.append(y))
    monkeypatch.setattr(cotrain, "_small", lambda a, b, y: seen.append(y))
    cotrain.train(repeated, labels, max_labelled=10, max_unlabelled=10)
    assert len(seen[0]) == 14


def test_one_of_each_is_the_same_however_rows_are_split(spark, repeated):
    once = common.one_of_each(repeated.repartition(7), "doc_id").where("doc_id = 1").collect()
    again = common.one_of_each(repeated.repartition(3), "doc_id").where("doc_id = 1").collect()
    assert once == again and len(once) == 1
    assert common.one_of_each(repeated.limit(0), "doc_id").count() == 0
