"""All pairs of alike fingerprints against brute force."""

import numpy as np
import pytest


def plain(prints, least):
    sets = {p: {p[i : i + 8] for i in range(0, len(p), 8)} for p in prints if p}
    out = {}
    for a in sets:
        for b in sets:
            if a < b:
                j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
                if j >= least:
                    out[a, b] = j
    return out


@pytest.mark.parametrize("least", [0.2, 0.5, 0.8, 1.0])
def test_random_sets(spark, least):
    from veridian.llm.fingerprints import alike_fingerprints

    draw = np.random.default_rng(5)
    prints = ["", None]
    for _ in range(40):
        own = draw.integers(0, 60, draw.integers(1, 40))
        for gone in range(4):
            prints.append("".join(f"{v:08x}" for v in np.unique(own[gone:])))
    df = spark.createDataFrame([(p,) for p in prints + prints[:9]], "fingerprint string")
    rows = alike_fingerprints(df, least).collect()
    assert {(r.a, r.b): r.likeness for r in rows} == plain(set(prints), least) and len(rows) == len({(r.a, r.b) for r in rows})


def test_documents_far_apart_in_doc_id(spark):
    from veridian.llm.fingerprints import alike_fingerprints, fingerprint_documents

    words = [f"the {chr(97 + i % 26)}{chr(97 + i // 26)}x of a {chr(97 + i % 26)}{chr(97 + i // 26)}y" for i in range(60)]
    docs = [(1, " ".join(words)), (500, "nothing like it in the world of the others"), (1000, " ".join(words[:-2]))]
    prints = fingerprint_documents(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "fingerprint").collect()
    own = {r.fingerprint: r.doc_id for r in prints}
    found = alike_fingerprints(spark.createDataFrame([(p,) for p in own], "fingerprint string"), 0.8).collect()
    assert [{own[r.a], own[r.b]} for r in found] == [{1, 1000}]
