"""The near-duplicate stage on rows whose doc_id is missing or shared."""

A = "the quick brown fox jumps over the lazy dog near the river bank today"
B = "a completely different sentence about the weather in the northern hills tomorrow"
C = "yet another unrelated note on how to bake bread with very little yeast"


def kept(spark, rows):
    import corpus_pipeline

    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert out.columns == docs.columns
    return sorted(((r.doc_id, r.text, r.source) for r in out.collect()), key=str)


def test_unlinked_rows_stay_whatever_their_id(spark):
    rows = [(None, A, "x"), (None, B, "x"), (None, C, "x"), (7, A, "y"), (7, B, "y"), (None, None, "x"), (None, "", "x"), (7, None, "x"), (7, None, "x")]
    # A and B have copies in 7: of each pair the row with an id stays
    want = [r for r in rows if r not in ((None, A, "x"), (None, B, "x"))]
    assert kept(spark, rows) == sorted(want, key=str)


def test_linked_row_goes_though_its_id_is_kept_elsewhere(spark):
    rows = [(1, A, "x"), (2, A, "x"), (2, B, "x"), (None, C, "x"), (None, C, "x")]
    assert kept(spark, rows) == sorted([(1, A, "x"), (2, B, "x"), (None, C, "x")], key=str)


def test_ties_go_by_text_then_other_columns(spark):
    near = A + " !"
    rows = [(3, near, "x"), (3, A, "z"), (3, A, "y"), (4, A, "a"), (5, B, "x")]
    assert kept(spark, rows) == sorted([(3, A, "y"), (5, B, "x")], key=str)
