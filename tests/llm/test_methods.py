"""The methods behind the operators against plain versions of them."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_word_hashes_do_not_depend_on_windows(monkeypatch):
    from veridian.llm import _textbytes as T

    rng = np.random.default_rng(5)
    texts = [" ".join("".join(rng.choice(list("abcé")) for _ in range(int(rng.integers(1, 30)))) for _ in range(40)), "", None, "x" * 500, "a b " + "y" * 130 + " z"]
    whole = T.Words(pa.array(texts)).hashes()
    short = T.Words(pa.array(texts)).hashes(3)
    for window in (7, 16, 64):
        monkeypatch.setattr(T, "WINDOW", window)
        assert (T.Words(pa.array(texts)).hashes() == whole).all() and (T.Words(pa.array(texts)).hashes(3) == short).all()
    words = [w for t in texts for w in (t or "").split()]
    by = {}
    for w, h in zip(words, whole.tolist()):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)


def test_bm25_neighbours_match_plain_scores():
    from veridian.llm.packing import Bm25Shard

    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 40, size=int(rng.integers(0, 30))) for _ in range(60)]
    index = Bm25Shard(np.concatenate(docs), np.append(0, np.cumsum([len(d) for d in docs])))
    n, mean = len(docs), np.mean([len(d) for d in docs])
    df = Counter(t for d in docs for t in set(d.tolist()))
    idf = {t: max(0.0, math.log((n - c + 0.5) / (c + 0.5))) for t, c in df.items()}
    for seed in range(n):
        want = []
        for d in docs:
            tf = Counter(d.tolist())
            want.append(sum(idf[t] * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in set(docs[seed].tolist()) if tf[t]))
        assert index.scores(seed) == pytest.approx(want, abs=1e-4)


def test_windows_are_filled_with_the_best_unused_neighbours():
    from veridian.llm.packing import Bm25Shard, Packer

    rng = np.random.default_rng(2)
    docs = [rng.integers(100 * (i % 3), 100 * (i % 3) + 60, size=20).astype(np.uint16) for i in range(30)]
    bounds = np.arange(31) * 20
    packer = Packer(100, 0)
    packer.shard(list(range(30)), np.concatenate(docs), bounds)
    rows = {}
    for doc, start, length, _, _, sequence, offset in packer.rows:
        rows.setdefault(sequence, []).append((offset, doc))
    index, used = Bm25Shard(np.concatenate(docs), bounds), set()
    for sequence in sorted(rows):
        placed = [d for _, d in sorted(rows[sequence])]
        seed, rest = placed[0], placed[1:]
        used.add(seed)
        score = index.scores(seed)
        open_ = sorted((d for d in range(30) if d not in used and score[d] > 0), key=lambda d: (-score[d], d))
        assert rest == open_[: len(rest)] or len(open_) < len(rest)
        used |= set(rest)


def plain_mixture(lik, rounds=12):
    """EM and backward selection for one document, word by word."""

    def fit(pi):
        for _ in range(rounds):
            r = lik * pi
            r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-30)
            new = r.mean(axis=0)
            done = np.abs(new - pi).max() <= 0.01
            pi = new
            if done:
                break
        return pi, np.log(np.maximum((lik * pi).sum(axis=1), 1e-30)).sum()

    pi, best = fit(np.full(lik.shape[1], 1 / lik.shape[1]))
    active = list(range(lik.shape[1]))
    while len(active) > 1:
        weakest = min(active, key=lambda k: (pi[k], k))
        other = pi.copy()
        other[weakest] = 0
        if other.sum() <= 0:
            break
        other, ll = fit(other / other.sum())
        if ll + 0.5 * math.log(max(2, len(lik))) < best:
            break
        active.remove(weakest)
        pi, best = other, ll
    return pi


def test_language_mixtures_match_a_plain_version():
    from veridian.llm.language_id import _mixture

    rng = np.random.default_rng(3)
    lik = [rng.dirichlet([0.3] * 4, size=int(rng.integers(1, 60))).astype(np.float64) for _ in range(40)]
    got = _mixture(np.concatenate(lik), np.append(0, np.cumsum([len(x) for x in lik])), 12, 0.01)
    for row, x in zip(got, lik):
        assert row == pytest.approx(plain_mixture(x), abs=1e-3)


def plain_spots(text, anchors, chain=2):
    """Signatures as tuples of words."""
    words = re.findall("[a-z\x80-\U0010ffff]+", lower(text))
    out = set()
    for i, w in enumerate(words):
        if w in anchors:
            rest = [x for x in words[i + 1 :] if x not in anchors]
            if len(rest) >= chain:
                out.add((w, *rest[:chain]))
    if not out:
        out = {tuple(words[i : i + chain]) for i in range(len(words) - chain + 1)} or ({tuple(sorted(words))} if words else set())
    return out


def test_spot_signatures_match_a_plain_version():
    from veridian.llm.fingerprints import ANCHORS, SpotSets, _hashes, likeness

    rng = np.random.default_rng(4)
    pool = ["the", "of", "der", "und", "est", "tree", "häuser", "stone", "river", "agua", "blue"]
    texts = [" ".join(rng.choice(pool, size=int(rng.integers(0, 30)))) for _ in range(80)] + ["", None, "tree", "tree stone", "the", "THE Tree, stone-river"]
    sets = SpotSets(pa.array(texts), _hashes(list(ANCHORS)))
    plain = [plain_spots(t or "", set(ANCHORS)) for t in texts]
    assert sets.sizes.tolist() == [len(p) for p in plain]
    near = likeness(sets, sets, 1)
    for i, (a, b) in enumerate(zip(plain, plain[1:])):
        assert near[i] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)


def test_language_model_matches_a_plain_version(spark):
    """Scores of texts whose weights are learned from cells, against counts of tuples with the same weights."""
    from veridian.llm import language_model as L

    rng = np.random.default_rng(6)
    pool = "a b c d e f g".split()
    rows = [(i, " ".join(rng.choice(pool, size=int(rng.integers(0, 25)), p=[0.4, 0.2, 0.15, 0.1, 0.05, 0.05, 0.05])), i % 7 == 2) for i in range(120)]
    rows += [(200, None, False), (201, "a a a", False), (201, "a a a", False), (202, "zz unseen a", True)]
    held = {}
    learn = L.interpolation_weights
    try:
        L.interpolation_weights = lambda cells, p0, rounds=200: held.setdefault("w", learn(cells, p0, rounds))
        got = L.score_texts(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean"), chunk_bytes=500, shard_keys=50).collect()
    finally:
        L.interpolation_weights = learn
    tokens = lambda t: [*WORD.findall(lower(t)), None]
    counts = Counter()
    for _, t, out in rows:
        if not out:
            seq = ["^", "^", *tokens(t)]
            for k in range(2, len(seq)):
                counts[(seq[k],)] += 1
                counts[(seq[k - 1], seq[k])] += 1
                counts[(seq[k - 2], seq[k - 1], seq[k])] += 1
    texts = sum(not out for _, _, out in rows)
    n = sum(c for k, c in counts.items() if len(k) == 1)
    v = sum(len(k) == 1 for k in counts)
    bits = lambda c: min(L.BUCKETS - 1, math.ceil(math.log2(c + 1)))
    want = Counter()
    for d, t, _ in rows:
        total, seq = 0.0, ["^", "^", *tokens(t)]
        for k in range(2, len(seq)):
            g, h, w = seq[k - 2 : k + 1]
            one = texts if h == "^" else counts[(h,)]
            two = texts if h == "^" else counts[(g, h)]
            a = held["w"][L.BUCKETS + bits(two) if two else bits(one)]
            p = a[0] * (counts[(g, h, w)] / two if two else 0) + a[1] * (counts[(h, w)] / one if one else 0) + a[2] * counts[(w,)] / n + a[3] / (v + 1)
            total += math.log10(p)
        want[d, round(total, 6)] += 1
    assert Counter((r.doc_id, round(r.score, 6)) for r in got) == want
    assert all(abs(w.sum() - 1) < 1e-9 and (w >= 0).all() for w in held["w"])


def test_interpolation_weights_raise_the_held_out_likelihood():
    from veridian.llm.language_model import BUCKETS, interpolation_weights

    rng = np.random.default_rng(7)
    cells = np.column_stack([rng.integers(0, 2 * BUCKETS, 300), rng.integers(1, 50, 300), rng.random(300), rng.random(300) * 0.1, rng.random(300) * 0.01])
    w = interpolation_weights(cells, 1e-3)
    flat = np.tile([0.25] * 4, (2 * BUCKETS, 1))
    like = lambda w: (cells[:, 1] * np.log((w[cells[:, 0].astype(int)] * np.column_stack([cells[:, 2:5], np.full(300, 1e-3)])).sum(axis=1))).sum()
    assert like(w) > like(flat)
    assert (w[:BUCKETS, 0] == 0).all() and w[0, 1] == 0


def test_extreme_value_lambda_solves_its_equation():
    from veridian.llm.toxicity import _karlin_lambda

    values, share = np.array([-1.0, -0.5, 0.25, 2.0]), np.array([0.6, 0.3, 0.05, 0.05])
    lam = _karlin_lambda(values, share)
    assert lam > 1e-3 and (share * np.exp(lam * values)).sum() == pytest.approx(1.0, abs=1e-6)


def test_toxicity_evidence_matches_its_formula():
    from veridian.llm._textbytes import NOT_LETTER, Words
    from veridian.llm.toxicity import Scorer, maximal_segments

    words = Words(pa.array(["bad", "worse"]), NOT_LETTER)
    scorer = Scorer(words.hashes(), np.array([2.0, 3.0]), -0.5, lam=0.7, k=0.2, a=1.5, b=-2.0)
    texts = ["good bad good good worse bad", "good good", None, "bad " * 30]
    value, spans = scorer.evidence(pa.array(texts), spans=True)
    for text, got in zip(texts, value):
        w = (text or "").split()
        gain = [0.7 * s - math.log(0.2 * max(1, len(w))) for _, _, s in maximal_segments(np.array([{"bad": 2.0, "worse": 3.0}.get(x, -0.5) for x in w]))]
        assert got == pytest.approx(max(max(gain), sum(g for g in gain if g > 0)) if gain else 0.0, rel=1e-5)
    assert scorer.probability(value) == pytest.approx(1 / (1 + np.exp(-(1.5 * np.clip(value, -30, 60) - 2.0))))
    assert spans[3][0]["start"] == 0 and spans[1] is None


def test_shared_rows_over_batches():
    from veridian.llm.ngram_join import _shared_rows

    rows = [(1, 0, 5), (1, 0, 5), (2, 0, 1), (2, 0, 2), (2, 0, 2), (3, 0, 9), (4, 1, 7), (5, 2, 1), (5, 2, 3), (6, 0, 1), (6, 0, 2), (6, 0, 3)]
    want = [(2, 1), (2, 2), (4, 7), (5, 1), (5, 3), (6, 1), (6, 2), (6, 3)]
    for size in (1, 2, 3, 5, 12):
        batches = [pa.record_batch([pa.array(c) for c in zip(*rows[i : i + size])], names=["key", "slice", "cls"]) for i in range(0, len(rows), size)]
        got = [r for b in _shared_rows(iter(batches)) for r in zip(b["key"].to_pylist(), b["cls"].to_pylist())]
        assert got == want


def test_classes_that_share_a_hash_stay_apart(spark, monkeypatch):
    from veridian.llm import ngram_join as N

    whole = N.class_of
    # one bit for the first hash: nearly all classes share it
    monkeypatch.setattr(N, "class_of", lambda u: (None, None) if not len(u) else (whole(u)[0] & 1, whole(u)[1]))
    first, second = (N.class_of(np.array([k], np.uint64)) for k in (1, 2))
    names = N.ClassNames({first[0]: min(first[1], second[1])} if first[0] == second[0] else {})
    assert names(np.array([1], np.uint64)) != names(np.array([2], np.uint64))


def test_large_blocks_are_cut_without_losing_pairs(spark):
    from veridian.llm.ngram_join import _tiles

    rng = np.random.default_rng(8)
    rows = [(1, 1, 0, 300, int(c), int(n), b"", int(c)) for c, n in enumerate(rng.integers(50, 200, 300))] + [(2, 9, 0, 3, 1000 + c, 10, b"", c) for c in range(3)]
    members = spark.createDataFrame(rows, "key long, leader long, deal long, rows long, cls long, n int, vec binary, label long")
    tiles = {}
    for r in _tiles(members, 16, 80).collect():
        tiles.setdefault((r.key, r.tile), []).append(r)
    met = set()
    for part in tiles.values():
        for a in part:
            for b in part:
                if a.cls < b.cls and (a.side != b.side or a.side == 2):
                    met.add((a.key, a.cls, b.cls))
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[4] < b[4] and 100 * min(a[5], b[5]) >= 80 * max(a[5], b[5]):
                assert (a[0], a[4], b[4]) in met
    assert max(len(p) for p in tiles.values()) < 120


def test_columns_of_any_name_and_type_are_kept(spark):
    import corpus_pipeline
    from veridian.llm.mixing import mix_documents

    text = "the quick brown fox jumps over the lazy dog near the river bank"
    rows = [(i, f"{text} {i}", "en", "s", 1, "mine") for i in range(12)] + [(None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, lang_pred string")
    for c in ("_row", "_first", "_group", "row", "copies", "_copy", "toxic_score", "h", "tie", "size", "other0", "source_size"):
        docs = docs.withColumn(c, F.lit(f"own {c}"))
    docs = docs.withColumn("map", F.create_map(F.lit("k"), F.lit(1)))
    kinds = docs.dtypes
    mixed = mix_documents(docs)
    assert mixed.dtypes == kinds and mixed.filter("_copy <> 'own _copy'").count() == 0
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.dtypes == kinds, name
        assert out.filter("toxic_score <> 'own toxic_score' or lang_pred <> 'mine'").count() == 0


def test_grafted_tree_finds_neighbours(spark):
    from veridian.llm.ann_tree import nearest_neighbours

    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 6)) + rng.integers(0, 5, size=(1500, 1)) * 4
    made = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[3].tolist()), (0, x[3].tolist())]
    df = spark.createDataFrame(made, "vec_id long, embedding array<double>").withColumn("rank", F.lit("own"))
    got = nearest_neighbours(df, lambda v: v % 50 == 0, leaves_most=6, branching=4, graft_rows=100, block_rows=40).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    hit = 0
    for q, found in by.items():
        if q == 0:
            # two vectors under one id are two queries
            assert sorted(r.rank for r in found) == sorted([*range(1, 11)] * 2)
            continue
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        best = [i for i in np.lexsort((np.arange(1500), d)) if i != q][:10]
        hit += len(set(best) & {r.vec_id for r in found})
    assert len(by) == 30 and hit / (10 * (len(by) - 1)) >= 0.9


def test_urls_are_rejected_by_their_own_labels_only(spark):
    from veridian.llm.url_filter import judge_urls

    made = [(i, f"http://b.net/es/{i}") for i in range(40)] + [(100 + i, f"http://b.net/de/{i}") for i in range(40)]
    made += [(200 + i, f"http://c.net/{'es' if i % 2 else 'zz'}/{i}") for i in range(6)] * 2 + [(300, "http://d.net/" + "x" * 100_000)]
    rules = (("block", "net", "/es/"), ("allow", "net", "/es/7"))
    got = {r.page_id: r for r in judge_urls(spark.createDataFrame(made, "page_id long, url string").withColumn("host", F.lit("own")), rules).collect()}
    assert got[0].verdict == "block" and got[7].verdict == "allow"
    assert all(got[100 + i].verdict == "allow" and got[100 + i].purity <= 0.5 for i in range(40))
    assert got[300].verdict == "allow"


def test_sequences_and_masks_are_views(tmp_path):
    from veridian.llm.token_stream import SequenceFile, SequenceReader

    path, ids = tmp_path / "x.arrow", np.arange(1, 1000, dtype=np.uint16)
    with open(path, "wb") as f:
        out = SequenceFile(f, 64, np.uint16, rows=4)
        for part in np.array_split(ids, 7):
            out.add(part)
        out.close()
    reader = SequenceReader(f"file://{path}")
    assert out.n_sequences == 16 and (np.concatenate(list(reader.flat_batches())) == ids).all()
    kept = []
    for i in range(16):
        sequence, mask = reader.sequence(i)
        assert len(sequence) == len(mask) == 64 and not sequence.flags.owndata and not mask.flags.owndata
        kept.append(sequence[mask])
    assert (np.concatenate(kept) == ids).all()


def test_language_counts_are_small_and_read_in_small_blocks():
    import tracemalloc

    import pyarrow as pa

    from veridian.llm import language_id as L

    few = pa.record_batch([pa.array(["en", "de"]), pa.array(["the quick brown fox", "der schnelle fuchs"])], names=["lang", "text"])
    rows = list(L._slot_counts(iter([few])))
    # two whole tables take 4 MB
    assert sum(r.nbytes for r in rows) < 20_000
    again = [L._add_slots(pa.Table.from_batches([r, r])) for r in rows]
    assert all(np.array_equal(2 * np.frombuffer(r["counts"][0].as_py()), np.frombuffer(a["counts"][0].as_py())) for r, a in zip(rows, again))

    rng = np.random.default_rng(5)
    words = ["".join(map(chr, rng.integers(97, 123, 7))) for _ in range(400_000)]
    many = pa.record_batch([pa.array(["en"] * 400), pa.array([" ".join(words[i :: 400]) for i in range(400)])], names=["lang", "text"])
    tracemalloc.start()
    list(L._slot_counts(iter([many])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20, peak


def test_stages_pass_small_batches(spark, tmp_path):
    import corpus_pipeline
    from veridian.llm._shared import BATCH_BYTES, small_batches

    rows = spark.range(2_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 500).alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source"))
    rows.coalesce(1).write.parquet(str(tmp_path / "documents"))
    docs = spark.read.parquet(str(tmp_path / "documents"))
    before = spark.conf.get(BATCH_BYTES)
    try:
        spark.conf.set(BATCH_BYTES, "64m")
        corpus_pipeline.language_stage(spark, docs, "")

        def sizes(batches):
            for b in batches:
                yield pa.record_batch([pa.array([b.nbytes])], names=["bytes"])

        assert docs.mapInArrow(sizes, "bytes long").agg(F.max("bytes")).first()[0] < 3 << 20
        spark.conf.set(BATCH_BYTES, "100k")
        small_batches(spark)
        assert spark.conf.get(BATCH_BYTES) == "100k"
    finally:
        spark.conf.set(BATCH_BYTES, before)


def test_pieces_are_kept_as_bytes_and_windows_are_small():
    import tracemalloc

    from veridian.llm import _textbytes as T
    from veridian.llm._bpe import ColumnEncoder, default_tokenizer

    enc = ColumnEncoder(default_tokenizer())
    rng = np.random.default_rng(5)
    texts = [" ".join("".join(map(chr, rng.integers(97, 123, 9))) for _ in range(100)) for _ in range(200)]
    whole = [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    tracemalloc.start()
    ids, bounds = enc.encode(pa.array(texts))
    kept = tracemalloc.get_traced_memory()[0] - ids.nbytes - bounds.nbytes
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == whole
    # some 58 bytes for the text, 45 for its ids and 40 for its place
    assert kept < 180 * 20_000, kept
    T._POWERS.clear()
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    T.Words(pa.array(["some words " * 400_000])).hashes()
    peak = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    # the words of the text take 40 MB, a window of 1 MB and its powers took 70 more
    assert peak < 64 << 20, peak


def test_pieces_met_before_are_not_encoded_again():
    from veridian.llm._bpe import ColumnEncoder, default_tokenizer

    class Counted:
        def __init__(self, model):
            self.model, self.calls = model, 0

        def tokenize(self, piece):
            self.calls += 1
            return self.model.tokenize(piece)

    enc = ColumnEncoder(default_tokenizer())
    enc.model = Counted(enc.model)
    rng = np.random.default_rng(7)
    words = ["".join(map(chr, w)) for w in rng.integers(97, 123, (150_000, 8))]
    columns = [pa.array([" ".join(words[i::6])]) for i in range(6)]
    first = [enc.encode(c)[0] for c in columns]
    calls = enc.model.calls
    assert all(np.array_equal(enc.encode(c)[0], ids) for c, ids in zip(columns, first))
    # pieces that share a place are encoded again, a quarter of them
    assert enc.model.calls - calls < 60_000, enc.model.calls - calls


@pytest.mark.parametrize("slots", [1, 8, 1 << 19])
def test_pieces_that_share_a_place_keep_their_ids(slots):
    from veridian.llm import _bpe

    enc = _bpe.ColumnEncoder(_bpe.default_tokenizer())
    enc.table = _bpe.PieceTable(enc.dtype, slots)
    texts = [
        "a", "a\0", "a\0\0", "\0" * 7, "\0" * 8, "\0" * 15, "\0" * 16, "\0" * 40, "abcdefgh", "abcdefghi", "abcdefgh\0", "abcdefghijklmno", "abcdefghijklmnop",
        "été ÈÉÊ ß×÷ ÿ", "превосходительство словарь", "\x1c", "\x85", "!!!", "!!!!!!!!!!!!!!!!!!", "0 1 12", "qzxjkvqzxjkv qzxjkvqzxjkvqzxjkv", None, "", " ",
    ]
    want = [enc.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    for column in (texts, texts[::-1], texts, texts * 3):
        ids, bounds = enc.encode(pa.array(column, pa.string()))
        by_text = dict(zip(texts, want))
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [by_text[t] for t in column]
