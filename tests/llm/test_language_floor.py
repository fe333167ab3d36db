"""A language that was left out of training is rejected; clean documents of learned ones stay."""

import pytest

from dermotrace.llm import language_id
from pyspark.sql import functions as F


@pytest.mark.parametrize("left_out", ["de", "es"])
def test_left_out_language(spark, left_out):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    held = language_id.fold("doc_id") == 2
    model = language_id.fit(docs.where(~held & (F.col("lang") != left_out)))
    got = language_id.predict(docs.where(held & (F.length("text") > 200)), model).select("lang", "rejected").collect()
    out, known = [r.rejected for r in got if r.lang == left_out], [r.rejected for r in got if r.lang != left_out]
    assert len(out) > 5 and sum(out) >= 0.95 * len(out)
    assert sum(known) <= 0.03 * len(known)


def test_foreign_prose(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(language_id.fold("doc_id") != 2))
    for text in (
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    ):
        assert language_id.classify(text, model)[2]
