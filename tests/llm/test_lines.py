"""Operator 13 against a plain version, by broadcast and by dealt-out join."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

import oracle
from dermotrace.llm import line_dedup

DOCS = "doc_id long, text string, rid long, key string, lost string, lines int, at int"


def plain(docs, points=20, least=3):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    rank = lambda i: (i is not None, i or 0)
    split = [(i, (t or "").split("\n")) for i, t in docs]
    holders = defaultdict(list)
    for i, lines in split:
        for k in {key(x) for x in lines if len(key(x)) >= points}:
            holders[k].append(rank(i))
    gone = {k: max(h) for k, h in holders.items() if len(h) >= least}
    out = []
    for i, lines in split:
        kept = [x for x in lines if rank(i) >= gone.get(key(x), rank(i))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def frame(spark, docs):
    return spark.createDataFrame([(i, t, 1, "k", "l", 2, 3) for i, t in docs], DOCS)


def got(df):
    return Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in df.collect())


CASES = [
    (1, None), (2, ""), (3, "\n\n"), (4, " A shared line of text, long \n own one\n a shared LINE of text, long"), (5, "x\na shared line of text, long\t"), (5, "\x0ba shared line of text, long"),
    (9, "a shared line of text, long\nA SHARED LINE OF TEXT, LONG\nlast"), (None, "a shared line of text, long"), (6, "ÄÖÜ shared line of text"), (7, "äöü shared line of text"), (8, "ÄÖÜ Shared line of TEXT\r"),
    (10, "nineteen code points"[:19]), (11, "nineteen code points"[:19]), (12, "nineteen code points"[:19]), (13, "twenty code points !"), (14, "twenty code points !"), (15, "twenty code points !\n"),
    (16, "\xa0a shared line of text, long"), (17, "only two hold this long line"), (18, "only two hold this long line"), (None, "a null id, a null id, a null id"), (None, "a null id, a null id, a null id"), (None, "a null id, a null id, a null id"),
    (19, "\n".join(["the same line again and again"] * 4000 + ["end"])), (20, "the same line again and again"), (21, "the same line again and again\nkept"), (22, "日本語" * 10), (23, "日本語" * 10), (24, "日本語" * 10),
]


@pytest.mark.parametrize("few", [200_000, 0])
def test_cases(spark, monkeypatch, few):
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", few)
    assert got(line_dedup.drop_shared_lines(frame(spark, CASES))) == plain(CASES)


@pytest.mark.parametrize("few", [200_000, 0])
def test_random(spark, monkeypatch, few):
    """A line in all rows, some in many: its rows are dealt to several tasks."""
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", few)
    rng = random.Random(3)
    pool = [f"{' ' * rng.randrange(3)}line {i} {'of many words' * rng.randrange(4)}" for i in range(60)]
    docs = [(rng.randrange(-500, 500), "\n".join(["One line that everyone has", *rng.choices(pool, k=rng.randrange(8))])) for _ in range(900)]
    assert got(line_dedup.drop_shared_lines(frame(spark, docs).repartition(7))) == plain(docs)
    assert got(line_dedup.drop_shared_lines(frame(spark, docs), 30, 12)) == plain(docs, 30, 12)


def test_world(spark, world):
    oracle.same(line_dedup.query(spark, world[0]), line_dedup.SQL, world[0])
    want = Counter((i, n, d, hashlib.sha256(k.encode()).hexdigest()) for (i, n, d, k), m in plain([(d[0], d[1]) for d in world[1]]).items() for _ in range(m))
    assert Counter(tuple(r) for r in line_dedup.query(spark, world[0]).collect()) == want


def test_no_python(spark, world):
    plan = line_dedup.query(spark, world[0])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
