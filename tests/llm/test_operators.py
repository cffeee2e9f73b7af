"""The ten operators on small, awkward tables, against brute force where there is no SQL."""

import hashlib
import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

os.environ["TOKENIZERS_PARALLELISM"] = "false"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    words = {"en": "the of and house tree water thing stone going".split(), "de": "der die und Häuser Bäume Wasser über schön gehen".split()}
    out = []
    for i in range(60):
        lang = "en" if i % 3 else "de"
        text = " ".join(rng.choice(words[lang], size=int(rng.integers(6, 60))))
        out.append((i, text + (" idiot scum trash" * 3 if i % 5 == 0 else ""), lang, f"s{i % 4}", len(text)))
    base = " ".join(f"w{k}" for k in range(100))
    out += [(100, base, "en", "s1", 1), (101, base, "en", "s1", 1), (102, base.replace("w50", "x"), "en", None, 1), (103, base.replace("w50 ", "w50  \n"), "en", "s2", 1)]
    out += [(110, None, None, None, None), (111, "", "en", "s0", 0), (112, " \t\n", "en", "s0", 3), (113, "one two", "en", "s0", 7), (114, "one two", "en", "s0", 7), (115, "123 !!", "en", "s9", 6)]
    out += [(120, "long words " * 20_000, "en", "s3", 1), (113, "one two", "en", "s0", 7), (None, "no id at all here now", "en", "s0", 1)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    # another column whose name a result could use
    return spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("mine")).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def ids(rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [(r[0], np.array(t.encode(r[1] or "", add_special_tokens=False).ids + [2], dtype="<u4")) for r in rows]


def test_encoder_equals_the_library():
    from veridian.llm._bpe import default_tokenizer, encoder

    texts = ["It's THE 'smile' we'll x1234 é <|startoftext|>abc", None, "", "a b\x1cc\x00 İstanbul ΣΣ don't!! -'s ''s ».… a̸≮", "<|endoftext|> a<|b", "Häuser-über 3,5 €"]
    e = encoder(default_tokenizer())
    flat, bounds = e.encode(pa.array(texts), 2)
    for i, t in enumerate(texts):
        assert flat[bounds[i] : bounds[i + 1]].tolist() == e.tokenizer.encode(t or "", add_special_tokens=False).ids + [2]


def test_packing_is_exact(docs, empty, ids):
    from veridian.llm.packing import pack_documents

    pieces = pack_documents(docs, window=256, shard_tokens=2000).collect()
    assert pack_documents(empty).count() == 0
    want = Counter((d, len(x), zlib.crc32(x)) for d, x in ids)
    total = {}
    for p in pieces:
        total.setdefault(p.sequence_id, []).append(p)
    assert sum(p.length for p in pieces) == sum(len(x) for _, x in ids)
    for seq in total.values():
        at = 0
        for p in sorted(seq, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 256 or at & (at - 1) == 0
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
    for d, x in ids:
        if sum(1 for e, _ in ids if e == d) == 1:
            at = 0
            for p in sorted(by_doc[d], key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(x) and p.ids_crc32 == zlib.crc32(x[at : at + p.length])
                at += p.length
            assert at == len(x)
    assert want


def test_token_stream_round_trip(spark, docs, empty, ids):
    from veridian.llm._shared import new_folder
    from veridian.llm.token_stream import SequenceReader, read_token_stream, write_token_stream

    folder = new_folder(spark, "tokens-test")
    manifest = write_token_stream(docs, folder, seq_len=64)
    got = sorted((r.start, r.n_tokens, r.ids_crc32) for r in read_token_stream(spark, manifest).collect())
    assert Counter((n, c) for _, n, c in got) == Counter((len(x), zlib.crc32(x)) for _, x in ids)
    assert [g[0] for g in got] == np.cumsum([0, *[g[1] for g in got[:-1]]]).tolist()
    order = [r.doc_id for r in read_token_stream(spark, manifest).orderBy("start").collect()]
    assert order == sorted(order, key=lambda d: -1 if d is None else d)
    row = manifest.filter("n_sequences > 1").first()
    sequence, mask = SequenceReader(f"{row.path}.arrow").sequence(0)
    assert len(sequence) == 64 and mask.all()
    assert read_token_stream(spark, write_token_stream(empty, new_folder(spark, "tokens-test"))).count() == 0


def test_mixing(docs, empty):
    from veridian.llm.mixing import mix_documents, mixing_plan, source_targets, word_count

    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.lit(0).alias("tie"))
    t = {r.source: r for r in source_targets(sized).collect()}
    total = sum(r.source_size for r in t.values())
    assert sum(r.target for r in t.values()) == pytest.approx(total)
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate([*sorted(s for s in t if s is not None), None])}
    targets, full = {}, set()
    while True:  # plain reading: share by weight, stop at three times the size, share the rest again
        left = total - sum(3 * t[s].source_size for s in full)
        open_weight = sum(weights[s] for s in t if s not in full)
        targets = {s: 3 * t[s].source_size if s in full else left * weights[s] / open_weight for s in t}
        over = {s for s in t if s not in full and targets[s] > 3 * t[s].source_size}
        if not over:
            break
        full |= over
    for s in t:
        assert t[s].target == pytest.approx(targets[s])
    plan = mixing_plan(sized).collect()
    assert len(plan) == docs.count() and all(0 <= r.copies <= 3 for r in plan)
    assert plan and mix_documents(docs).count() == sum(r.copies for r in mixing_plan(sized).collect())
    assert mix_documents(docs).columns == docs.columns
    assert mix_documents(empty).count() == 0


def test_language_id(docs, empty):
    from veridian.llm.language_id import identify

    out = identify(docs, docs.filter("doc_id < 40"), per_language=50)
    got = {r.doc_id: r for r in out.collect()}
    assert all(got[i].lang_pred == ("en" if i % 3 else "de") for i in range(60))
    assert got[110].lang_pred == got[111].lang_pred == got[115].lang_pred == "und" and got[110].lang_score == 0
    assert all(0 <= r.lang_score <= 1 for r in got.values()) and got[5].score == "mine"
    assert identify(empty, docs).count() == 0
    assert {r.lang_pred for r in identify(docs, empty).collect()} == {"und"}


def test_fingerprints(spark, docs, empty, rows):
    from veridian.llm.fingerprints import fingerprint_documents

    got = fingerprint_documents(docs).collect()
    assert len(got) == len(rows) and fingerprint_documents(empty).count() == 0
    order = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] is not None, r[1] or ""))
    want = Counter()
    for own, following in zip(order, order[1:] + order[:1]):
        text, other = own[1] or "", following[1] or ""
        half = len(text) // 2
        want[own[0], len(text), hashlib.sha256((text[: len(text) - half] + other[:half]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    print_of = {r.doc_id: r.fingerprint for r in got}
    assert print_of[100] == print_of[101] and print_of[113] == print_of[114] and print_of[110] == ""
    sets = lambda f: {f[i : i + 8] for i in range(0, len(f), 8)}
    for r in got:
        a, b = sets(r.fingerprint), sets(r.edited_fingerprint)
        assert r.near_edited == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)


def brute_components(rows):
    sets = []
    for r in rows:
        w = WORD.findall(lower(r[1]))
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
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return Counter((r[0], len(sets[i]), least.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rows))


def test_ngram_join(spark, docs, empty, rows):
    from veridian.llm.ngram_join import ngram_components

    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_components(docs).collect())
    assert got == brute_components(rows)
    assert ngram_components(empty).count() == 0


def test_ngram_join_on_a_loose_group(spark):
    """Many near copies around the threshold, in blocks that are dealt as slices."""
    from veridian.llm.ngram_join import ngram_components

    rng = np.random.default_rng(1)
    base = [f"w{k}" for k in range(80)]
    made = []
    for i in range(70):
        words = list(base)
        for at in rng.choice(80, size=int(rng.integers(0, 4)), replace=False):
            words[at] = f"x{i}_{at}"
        made.append((i, " ".join(words)))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_components(spark.createDataFrame(made, "doc_id long, text string"), block_rows=16, stars=1).collect())
    assert got == brute_components(made)


def test_near_copies_that_do_not_link_are_no_pairs(spark, monkeypatch):
    """All 1,770 pairs of 60 near copies have count vectors that allow a link; pairs are never rows, and the links are found."""
    from veridian.llm import ngram_join as N

    rng = np.random.default_rng(2)
    made = []
    for i in range(60):
        words = [f"w{k}" for k in range(1000)]
        for at in rng.choice(1000, size=17, replace=False):
            words[at] = f"x{i}_{at}"
        made.append((i, " ".join(words)))
    made += [(100 + i, text.replace(f"w{5 * i} ", f"y{i} ")) for i, text in made[:10]]
    counts, write = {}, N.materialize

    def seen(df, name):
        out = write(df, name)
        if {"a", "b"} <= set(out.columns):
            counts[name] = out.count()
        return out

    monkeypatch.setattr(N, "materialize", seen)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in N.ngram_components(spark.createDataFrame(made, "doc_id long, text string"), stars=1).collect())
    assert got == brute_components(made)
    assert max(counts.values()) <= 2 * len(made)


def test_ann_tree(spark):
    from veridian.llm.ann_tree import nearest_neighbours

    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 8)) + rng.integers(0, 4, size=(400, 1)) * 3
    made = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[7].tolist()) for i in range(30)]
    made += [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [1.0, None] * 4), (2004, [1.0])]
    df = spark.createDataFrame(made, "vec_id long, embedding array<double>")
    got = nearest_neighbours(df, lambda v: v % 10 == 0, block_rows=50, leaves_most=16).collect()
    valid = {i: np.array(v) for i, v in made[:430]}
    hit = n = 0
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == {i for i in valid if i % 10 == 0}
    for q, found in by.items():
        found.sort(key=lambda r: r.rank)
        assert [r.rank for r in found] == list(range(1, 11))
        exact = sorted((float(np.sqrt(((valid[i] - valid[q]) ** 2).sum())), i) for i in valid if i != q)[:10]
        assert all(r.score == pytest.approx(float(np.sqrt(((valid[r.vec_id] - valid[q]) ** 2).sum())), rel=1e-12) for r in found)
        hit += len({i for _, i in exact} & {r.vec_id for r in found})
        n += 10
    assert hit / n >= 0.9
    assert nearest_neighbours(df.filter("vec_id < 4"), lambda v: v == 0).count() == 3
    assert nearest_neighbours(df.filter("vec_id >= 2000"), lambda v: v % 1 == 0).count() == 0


def test_lm_scoring(spark, docs, empty, rows):
    from veridian.llm.language_model import score_texts

    marked = docs.withColumn("held_out", F.coalesce(F.col("doc_id") % 7 == 2, F.lit(False)))
    got = score_texts(marked, chunk_bytes=2000, shard_keys=100).collect()
    assert len(got) == len(rows)
    tokens = lambda t: [*WORD.findall(lower(t)), None]
    c = Counter(w for r in rows if r[0] is None or r[0] % 7 != 2 for w in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for r in rows:
        t = tokens(r[1])
        base = sum(np.log10((c[w] + 1) / (n + v + 1)) for w in t)
        want[r[0], len(t), sum(w in c for w in t), n, round(base, 4)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score <= 0 for r in got) and sum(r.score for r in got) > sum(r.base_score for r in got)
    assert score_texts(empty.withColumn("held_out", F.lit(False))).count() == 0
    assert all(r.score == pytest.approx(0) for r in score_texts(docs.filter("doc_id < 5").withColumn("held_out", F.lit(True))).collect())


def test_segments_match_brute_force():
    from veridian.llm.toxicity import maximal_segments

    def brute(s, a, b):
        best = None
        for i in range(a, b):
            t = 0.0
            for j in range(i, b):
                t += s[j]
                if t > 0 and (best is None or t > best[2] + 1e-12):
                    best = (i, j + 1, t)
        return [] if best is None else [*brute(s, a, best[0]), best, *brute(s, best[1], b)]

    rng = np.random.default_rng(2)
    for _ in range(200):
        s = rng.uniform(-1, 0.8, size=int(rng.integers(1, 40)))
        assert [x[:2] for x in maximal_segments(s)] == [x[:2] for x in brute(s, 0, len(s))]


def test_toxicity(spark, docs, empty):
    from veridian.llm.toxicity import score_toxicity, train

    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(60)] + [(0, 1), (999, None)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in score_toxicity(docs, train(docs, labels)).collect()}
    assert all((out[i].toxic_score >= 0.3) == (i % 5 == 0) for i in range(60))
    assert out[110].toxic_score < 0.3 and out[110].toxic_spans == []
    assert out[5].toxic_spans and all(0 <= s.start < s.end for s in out[5].toxic_spans)
    assert score_toxicity(empty, train(docs, labels)).count() == 0
    one_class = train(docs, labels.filter("toxic = 0"))
    assert len({r.toxic_score for r in score_toxicity(docs, one_class).collect()}) == 1


def test_urls(spark):
    from veridian.llm.url_filter import judge_urls

    made = [(1, "https://A.COM/x?y"), (2, "http://www.example.com/en/1"), (3, "http://m.example.com/en/1"), (4, "http://a.net/es/2#t"), (5, None), (6, "no scheme/en/"), (7, "http://a.com"), (8, "x://a.com?u=http://b.net/es/")]
    made += [(100 + i, f"http://b.net/es/{i}") for i in range(20)] + [(200 + i, f"http://c.org/en/{i}.html") for i in range(20)]
    got = {r.page_id: r for r in judge_urls(spark.createDataFrame(made, "page_id long, url string")).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.com", "/x", "com/", "allow")
    assert got[2].rule == "www.example.com/en/" and got[3].rule == "example.com/en/" and got[3].verdict == "block"
    assert got[4].path == "/es/2" and got[4].verdict == "block"
    assert (got[5].host, got[5].path, got[5].rule) == ("", "", None) and got[6].host == ""
    assert got[7].rule is None and got[7].path == "" and got[8].host == "a.com"
    assert {got[200 + i].template for i in range(20)} == {"/en/*.html"} and got[200].verdict == "allow"
    assert judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_components(spark):
    from veridian.llm.components import components

    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
