"""Small worlds: every edge case in one set of tables, and the same tables empty."""

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rid long, h long, score double, rejected boolean, name string, bucket int, key string"


def documents() -> list[tuple]:
    rng = random.Random(7)
    words = {"en": "the of and to in that is was with for on this are by from".split(), "fr": "le la les des que qui dans une pour est sur avec plus être".split()}
    make = lambda lang, n: " ".join(rng.choice(words[lang]) + rng.choice(["", "ing", "ée", "tion", "s", str(rng.randrange(9))]) for _ in range(n))
    passage = make("en", 60)
    rows = [(i, make("en" if i % 3 else "fr", rng.randrange(1, 200)), "en" if i % 3 else "fr") for i in range(80)]
    rows += [(100 + i, f"{make('en', 30)} {passage}\n{make('en', 25)}", "en") for i in range(12)]
    rows += [(150 + i, rows[3][1], "fr") for i in range(4)] + [(160, rows[4][1].replace(" ", "\t\n"), "en"), (161, f"  {rows[4][1]} ", None)]
    base = rows[5][1] + " " + make("en", 150)
    rows += [(170 + i, base.replace("the", "teh", 1) if i % 2 else base, "en") for i in range(6)]
    rows += [(200, None, "en"), (201, "", "en"), (202, " \n ", None), (203, "...!!! 123", "en"), (None, "a null id of the text", "en"), (None, None, None), (204, "ab " * 40000, "en"), (204, "again", None), (205, "日本語 テキスト 😀", None)]
    rows += [(206, "x" * 5000, "en"), (207, "y" * 99, None), (208, "y" * 100, None), (209, "y" * 100, None), (-5, "y" * 101 + "é" * 60, None), (210, "a<|endoftext|>b  c\xa0 d\n\ne", "en"), (7, rows[7][1], rows[7][2]), (7, rows[7][1], rows[7][2])]
    rows += [(211, f"Before. Licensed under the Apache License, Version 2.0. {passage[:40]} Released under the MIT License.", "en")]
    return [(i, t, lang, f"src{(i or 0) % 3}" if i != 1 else None, len(t) if t else None, 1, 2, 0.5, True, "n", 3, "k") for i, t, lang in rows]


def write(spark, folder, docs) -> str:
    spark.createDataFrame(docs, DOCS).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    texts = [d[1] for d in docs if d[1]]
    items = [(1, " ".join(texts[10].split()[2:20])), (2, "no such words anywhere at all"), (3, None), (4, "..."), (5, texts[81][160:380]), (None, texts[9]), (6, "again"), (6, texts[11])] if docs else []
    spark.createDataFrame(items, "item_id long, text string").withColumnRenamed("x", "y").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    urls = ["https://www.Example.org/es/a?utm_x=1", "http://example.org/en/1/b", "http://a.net", "http://spam.net/p", "http://spam.net/p/", "http://m.spam.net/p?b=2&a=1#x", "no scheme", "", None, "http://x.com/fr/?q", "http://x.com/de/", "http://X.COM/de/", "ftp://com/fr/", "http://notorg/", "://org/", "http://spam.net/p", "http://é.org/ü"] if docs else []
    spark.createDataFrame([(i if i else None, u, "<p>", "h", "r") for i, u in enumerate(urls)], "page_id long, url string, html string, host string, rule string").write.mode("overwrite").parquet(f"{folder}/pages.parquet")
    labels = [(d[0], int((d[0] or 0) % 4 != 0), 0) for d in docs[:90]] + [(None, 1, 0), (3, None, None), (3, 0, 1)] if docs else []
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    talk = [(i % 9, i % 5, ("user", "assistant")[i % 2], (d[1] or "")[:40]) for i, d in enumerate(docs)]
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").write.mode("overwrite").parquet(f"{folder}/conversations.parquet")
    return folder


@pytest.fixture(scope="session")
def world(spark, tmp_path_factory):
    docs = documents()
    return write(spark, str(tmp_path_factory.mktemp("world")), docs), docs


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    return write(spark, str(tmp_path_factory.mktemp("empty")), [])
