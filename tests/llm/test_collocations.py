"""Operator 12 against its SQL and plain counting."""

import random
import re
from collections import Counter

import duckdb
import pyarrow as pa

from veridian.llm import collocations as co

LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows, least, most=4, top=2000):
    counts, sizes = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(w)
            for k in range(1, most + 1):
                counts.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    frequent = {g: f for g, f in counts.items() if len(g[1]) > 1 and f >= least}
    out = {}
    for (lang, w), a in frequent.items():
        inside = any(lg == lang and len(v) > len(w) and 100 * f >= 80 * a and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1)) for (lg, v), f in frequent.items())
        if not inside:
            cuts = []
            for k in range(1, len(w)):
                l, r = counts[lang, w[:k]], counts[lang, w[k:]]  # noqa: E741
                cuts.append((2000000 * a // (l + r), k, l, r))
            score, _, l, r = min(cuts)  # noqa: E741
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, i, p.decode(), -a, l, r, sizes[lang], -s) for lang, v in out.items() for i, (s, a, p, l, r) in enumerate(sorted(v)[:top], 1))


def found(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def fixture():
    draw = random.Random(11)
    words = ["the", "The", "new", "york", "times", "über", "été", "'tis", "a-b", "x y", "z"]
    ends = [" ", "  ", "\t", " ", ". ", "\n", " ; ", "\x0b"]
    rows = []
    for i in range(150):
        n = draw.randint(0, 60)
        text = "".join(draw.choice(words) + draw.choice(ends) for _ in range(n)) + ("New York  Times today" if i % 3 else "")
        rows.append((text, draw.choice(["en", "de", None, "und"])))
    return rows + [(None, "en"), ("", "fr"), (" \t.,", "en"), ("one two one two one two", "en")] + [("copied words here again", "en")] * 40


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = sorted(con.execute(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({co.op12_sql()})").fetchall())
    assert want and found(co.op12_collocations(spark, folder)) == want


def test_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(co, "GIVEN", 17)
    rows = fixture()
    df = spark.createDataFrame([(t, g, "x") for t, g in rows], "text string, lang string, phrase string").repartition(3)
    want = plain(rows, 12)
    assert {r[0] for r in want} >= {"en", "de", "und"} and any(len(r[2].split()) == 4 for r in want)
    assert found(co.collocations(df, least=12)) == want
    assert found(co.collocations(df, least=12, top=3)) == plain(rows, 12, top=3)


def test_products_beyond_64_bits(spark):
    grams = spark.createDataFrame([("en", "a", 9 * 10**18), ("en", "b", 9 * 10**18 - 1)], "lang string, phrase string, f long")
    pair = spark.createDataFrame([("en", "a b", 8 * 10**18)], "lang string, phrase string, f long")
    row = co._cuts(pair, grams).first()
    assert (row.score, row.l, row.r) == (2000000 * 8 * 10**18 // (18 * 10**18 - 1), 9 * 10**18, 9 * 10**18 - 1)
    assert co._outermost(pair.union(spark.createDataFrame([("en", "a b c", 64 * 10**17 - 1)], pair.schema)), 80).count() == 2
    assert co._outermost(pair.union(spark.createDataFrame([("en", "a b c", 64 * 10**17)], pair.schema)), 80).count() == 1


def test_nothing_frequent(spark):
    schema = "text string, lang string"
    assert co.collocations(spark.createDataFrame([], schema)).count() == 0
    assert co.collocations(spark.createDataFrame([("a b c", "en")], schema)).count() == 0
    assert found(co.collocations(spark.createDataFrame([("word " * 40, "en")], schema))) == [("en", 1, "word word word word", 37, 40, 38, 40, 948717)]


def test_blocks_with_few_words(spark):
    for text in ("a", "a b", "a b c", "a b c d"):
        assert found(co.collocations(spark.createDataFrame([(text, "en")], "text string, lang string"), least=1)) == plain([(text, "en")], 1)


def test_a_very_long_text(spark):
    long = "alpha beta gamma " * 100_000
    got = found(co.collocations(spark.createDataFrame([(long, "en")], "text string, lang string")))
    assert got == plain([(long, "en")], 30)


def test_gram_strings():
    g = co.Grams(pa.record_batch([pa.array(["en", "de"]), pa.array(["Aé b\tc. d", "e"])], names=["lang", "text"]))
    assert g.room.tolist() == [2, 1, 0, 0, 0]
    assert g.strings(pa.array([0, 1]).to_numpy(), 2).to_pylist() == ["aé b", "b c"]
    assert g.strings(pa.array([4]).to_numpy(), 1).to_pylist() == ["e"]
