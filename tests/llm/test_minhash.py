"""Operator 13 against brute force, and its parts."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from veridian.llm.minhash import BAND_SHIFT, band_keys, hash_functions, least_agreement, near_dedup, op13_minhash, signatures
from veridian.llm.ngram_join import shingle_sets

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows):
    """{doc_id: (n_shingles, component_id, kept)} of rows with distinct ids, by comparing all pairs of sets."""
    sets = {}
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets[doc_id] = frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert found(op13_minhash(spark, "/root/testdata/sf0.001")) == brute(rows)


def test_groups_around_the_threshold(spark):
    draw = random.Random(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows, n = [], 0
    for _ in range(12):
        base = [draw.choice(vocabulary) for _ in range(60)]
        for edits in (0, 0, 1, 1, 2, 3, 4, 6, 20):
            text = list(base)
            for at in draw.sample(range(len(text)), edits):
                text[at] = draw.choice(vocabulary)
            rows.append((n, " ".join(text)))
            n += 1
    draw.shuffle(rows)
    want = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(near_dedup(df)) == want
    assert found(near_dedup(df, block_rows=4, stars=1)) == want  # buckets in slices


def test_unlinked_near_copies_of_one_group(spark):
    """Texts that agree without linking meet in tasks, and the few links among them are found."""
    draw = random.Random(8)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for n in range(150):
        text = list(base)
        for at in draw.sample(range(80), 2 if n % 30 else 0):
            text[at] = f"x{draw.randint(0, 400)}"
        rows.append((n, " ".join(text)))
    want = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(near_dedup(df)) == want
    assert found(near_dedup(df, stars=1, block_rows=20)) == want


def test_defined_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "  \n", "x"), (4, "One two", "x"), (5, "one  TWO", "x"), (6, "one", "x"), (None, "a b c d", "x"), (8, "a b c d", "x"), (9, "q r s t", "x"), (9, "q r s t", "y"), (None, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup(df).collect()), key=str)
    want = [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (None, 2, 8, False), (8, 2, 8, True), (9, 2, 9, True), (9, 2, 9, True), (None, 0, None, True)]
    assert got == sorted(want, key=str)
    assert near_dedup(df.limit(0)).count() == 0


def test_one_very_long_text(spark):
    long = " ".join(str(i * i) for i in range(150_000))
    got = found(near_dedup(spark.createDataFrame([(1, long), (2, long + " end"), (3, "short one here")], "doc_id long, text string")))
    assert got == {1: (149_998, 1, True), 2: (149_999, 1, False), 3: (1, 3, True)}


def test_signatures_estimate_similarity():
    a, b = shingle_sets(pa.array([" ".join(map(str, range(1000))), " ".join(map(str, range(100, 1000)))]), 3)
    sig = signatures([a, b], 240)
    share = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((sig[0] == sig[1]).mean() - share) < 0.1
    mult, _ = hash_functions(240)
    assert (mult % 2 == 1).all() and len(set(mult.tolist())) == 240
    plain = [[min(((x >> 32) * int(m) + int(o)) % 2**32 for x in s.tolist()) % 256 for m, o in zip(*(v[:3] for v in hash_functions(240)))] for s in (a, b)]
    assert plain == sig[:, :3].tolist()


def test_bands():
    sig = np.arange(24, dtype=np.uint8).reshape(2, 12)
    keys = band_keys(sig, 3)
    assert keys.shape == (2, 3) and len(set(keys.ravel().tolist())) == 6
    sig[1, 4:8] = sig[0, 4:8]
    keys = band_keys(sig, 3)
    assert (keys[0] == keys[1]).tolist() == [False, True, False]
    assert (keys >> BAND_SHIFT).tolist() == [[0, 1, 2]] * 2


@pytest.mark.parametrize("count, percent, want", [(240, 85, 170), (64, 85, 37), (6, 85, 1)])
def test_least_agreement(count, percent, want):
    assert least_agreement(count, percent) == want
