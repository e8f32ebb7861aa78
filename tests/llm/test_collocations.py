"""Phrases against a plain count of every n-gram."""

from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from siltstone.llm import collocations, queries

COLUMNS = "doc_id long, text string, lang string, phrase string, piece int, m double, bucket long, n string, total int"


def plain(rows, least=100, first=2000, longest=5):
    n, f = Counter(), {}
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            own = f.setdefault(lang, Counter())
            for size in range(1, longest + 1):
                own.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, own in f.items():
        kept = {p: a for p, a in own.items() if a >= least and len(p) > 1}
        best = []
        for p, a in kept.items():
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in kept.items()):
                continue
            score, _, left, right = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(best)[:first], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def test_query_equals_plain_and_sql(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["text"], r["lang"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(queries.op11_collocations(spark, sf)) == plain(rows)
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert sorted(db.execute(f"select lang, rank, phrase, a, l, r, n, score from ({queries.ORACLE_SQL['op11_collocations']})").fetchall()) == plain(rows)


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(3)
    words = ["the", "The", "a", "of", "New York", "new", "YORK", "ÉA", "é", "x\x00y", "日本", "\U0001f600"]
    rows = [("".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ", "]) for _ in range(rng.randrange(60))), rng.choice(["en", "en", "en", "fr", None, "und", ""])) for _ in range(300)]
    return rows + [("one fixed passage that many share; " * 3, "en")] * 90 + [(None, "en"), ("", None), (" .,; \t", "de"), ("a a a a a a a a a a " * 4000, "fr"), ("lone", None)]


def test_odd_rows(spark, odd):
    df = spark.createDataFrame([(i, *r, "x", 1, 1.0, 2, "y", 3) for i, r in enumerate(odd)], COLUMNS)
    for least, first in ((100, 2000), (7, 20)):
        want = plain(odd, least, first)
        assert len(want) > 4
        assert got(collocations.mined(df.repartition(5), least=least, first=first)) == want
    for longest in (2, 3):
        assert got(collocations.mined(df, least=7, longest=longest)) == plain(odd, 7, longest=longest)
    assert collocations.mined(df.where("text is null")).count() == 0
    assert collocations.mined(df.where("false")).count() == 0


def test_buckets_of_any_size_give_the_same(spark, odd, monkeypatch):
    monkeypatch.setattr(collocations, "BUCKET_BYTES", 500)
    df = spark.createDataFrame(odd, "text string, lang string")
    assert got(collocations.mined(df, least=20)) == plain(odd, 20)


def test_counts_beyond_memory_are_whole(monkeypatch, spark):
    monkeypatch.setattr(collocations, "COUNT_MEMORY", "24MB")
    parts = spark.range(0, 600_000, 1, 2).selectExpr("'en' as lang", "id % 3 as bucket", "concat('a phrase of several words, number ', cast(id % 200000 as string)) as phrase", "1 + id % 5 as m")
    out = collocations.counted(parts, 1).where("phrase is not null").selectExpr("count(*) as n", "sum(total) as total").first()
    assert (out["n"], out["total"]) == (200_000, 1_800_000)


def test_products_beyond_64_bits(spark):
    big = 4_000_000_000_000
    counts = spark.createDataFrame([("en", "a", big), ("en", "b", big - 1), ("en", "a b", big // 3)], "lang string, phrase string, total long")
    row = collocations.scored(counts, spark.createDataFrame([("en", 3 * big)], "lang string, n long")).first()
    assert row["score"] == 1000 * (big // 3) * 3 * big // (big * (big - 1))


def test_places_within_a_piece():
    words = collocations.Words(pa.table({"piece": ["a b a b", "b", "a b"], "m": [2, 1, 5]}))
    phrases, m = words.counted(2, words.inside(2))
    assert dict(zip(phrases.to_pylist(), m.to_pylist(), strict=True)) == {"a b": 9, "b a": 2}
    assert words.known(pa.array(["b a", "q a"]), 2).tolist() == [False, True, False, False, False, False, False]
