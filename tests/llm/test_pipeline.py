"""The pipeline's stages, each on what the one before kept, against plain readings of what they promise."""

import re

import pytest
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline
    from veridian.llm._shared import materialize

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    # a repeated row, a text without letters, a null one, and a column of its own
    odd = spark.createDataFrame([(10_000, "123 !", "en", "src0", 5), (10_001, None, None, None, None)], docs.schema)
    out = [materialize(docs.union(odd).union(docs.filter("doc_id = 3")).withColumn("extra", F.lit(1)), "test")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], FOLDER), f"test-{name}"))
    return out


def test_columns_are_kept(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_language_rejects_only_what_it_cannot_tell(stages):
    gone = {r.doc_id for r in stages[0].select("doc_id").exceptAll(stages[1].select("doc_id")).collect()}
    assert {10_000, 10_001} <= gone and len(gone) <= 4


def test_toxicity_keeps_most(stages):
    assert 0.8 * stages[1].count() <= stages[2].count() <= stages[1].count()


def test_one_document_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[2].select("doc_id", "text").collect()]
    sets = []
    for _, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(set(least.values()))


def test_mixture_repeats_at_most_three_times(stages):
    before = {r.doc_id for r in stages[3].collect()}
    copies = {r.doc_id: r["count"] for r in stages[4].groupBy("doc_id").count().collect()}
    assert set(copies) <= before and max(copies.values()) <= 3


def test_packing_holds_every_token_once(stages):
    pieces = stages[5]
    total = pieces.agg(F.sum("length")).first()[0]
    whole = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t"))
    copies = stages[4].groupBy("doc_id").count()
    joined = whole.join(copies, "doc_id").collect()
    assert all(r.n == r.t * r["count"] for r in joined) and sum(r.n for r in joined) == total
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0


def test_empty_documents(spark, stages):
    import corpus_pipeline

    docs = stages[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert docs.count() == 0
