"""The mining loop against a plain one, step by step."""

import math

import numpy as np
import pytest

from veridian import registry
from veridian.operators import miner
from veridian.plans import mining_queries

RULES = miner.Rules(percentile=10.0, mask_area=(50.0, 1500.0), least_confidence=0.2, cluster_confidence=0.3, cluster_size=12, flush_every=3, window=3, slope=0.05, patience=3)


def cos(a, b):
    na, nb = math.sqrt(sum(x * x for x in a)) + 1e-8, math.sqrt(sum(x * x for x in b)) + 1e-8
    return sum(x / na * y / nb for x, y in zip(a, b))


def iou(a, b):
    both = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)


def plain(tokens, query, propose, r):
    """tokens: (token, x, y, w, vector).  Entropy is taken from the whole map at every step."""
    weight = {(x, y): w for _, x, y, w, _ in tokens}
    vector = {(x, y): v for _, x, y, _, v in tokens}
    cut = np.percentile([t[3] for t in tokens], r.percentile)
    entropy = lambda: -sum(w * math.log(w + 1e-10) for w in weight.values())
    seen, rows, history, boxes, held, ratios = set(), [], [], [], [], []
    reservoir, mean, steady, frozen = [], list(query), 0, False
    counter = bad = 0
    smooth = average = conf = None
    flushed = 0
    for token, x, y, w, _ in sorted((t for t in tokens if t[3] >= cut), key=lambda t: (-t[3], t[0])):
        row = {"token": token, "outcome": None}
        rows.append(row)
        if (x, y) in seen:
            row["outcome"] = "visited"
        else:
            x1, y1, x2, y2, area = propose(x * 14 + 7, y * 14 + 7)
            if not r.mask_area[0] <= area <= r.mask_area[1]:
                seen.add((x, y))
                weight[x, y] = r.floor
                bad += 1
                row["outcome"] = "bad mask"
            else:
                cells = [c for c in weight if x1 // 14 <= c[0] <= x2 // 14 and y1 // 14 <= c[1] <= y2 // 14]
                own = [sum(v) / len(cells) for v in zip(*(vector[c] for c in cells))]
                row["confidence"] = cos(own, mean)
                if row["confidence"] > r.cluster_confidence and not frozen:
                    entry = (row["confidence"], len(rows), own)
                    changed = len(reservoir) < r.cluster_size or entry[0] > min(reservoir)[0]
                    if changed:
                        if len(reservoir) == r.cluster_size:
                            reservoir.remove(min(reservoir))
                        reservoir.append(entry)
                        now = [sum(v) / len(reservoir) for v in zip(*(e[2] for e in reservoir))]
                        steady = steady + 1 if cos(now, mean) > 0.999 else 0
                        mean = now
                        frozen = steady >= r.cluster_size // 10 or len(reservoir) == r.cluster_size
                row["members"], row["frozen"] = len(reservoir), frozen
                if row["confidence"] < r.least_confidence:
                    row["outcome"] = "low confidence"
                    continue
                row["outcome"] = "object"
                for c in cells:
                    seen.add(c)
                    weight[c] = 0.0
                boxes.append({"box": (x1, y1, x2, y2), "score": row["confidence"], "status": "pending", "row": row})
                ratios.append(ratios[-1] if ratios else 0.0)
                conf = row["confidence"] if conf is None else 0.9 * conf + 0.1 * row["confidence"]
                row["smoothed_confidence"] = conf
                if len(boxes) - flushed == r.flush_every:
                    kept = []
                    for i in sorted(held + list(range(flushed, len(boxes))), key=lambda i: (-boxes[i]["score"], i)):
                        if all(iou(boxes[i]["box"], boxes[j]["box"]) <= r.overlap for j in kept):
                            kept.append(i)
                    replaced = len([i for i in held if i not in kept])
                    for i in range(flushed, len(boxes)):
                        boxes[i]["status"] = "discarded"
                    for n, i in enumerate([i for i in kept if i >= flushed]):
                        boxes[i]["status"] = "replacement" if n < replaced else "new"
                    share = sum(b["status"] == "discarded" for b in boxes) / len(boxes)
                    average = share if average is None else 0.9 * average + 0.1 * share
                    ratios[flushed:] = [average] * (len(boxes) - flushed)
                    held, flushed = kept, len(boxes)
        history.append(entropy())
        delta = history[-1] - history[-1 - r.window] if len(history) > r.window else 0.0
        smooth = delta if smooth is None else 0.99 * smooth + 0.01 * delta
        if len(history) - 1 > r.window:
            counter = counter + 1 if delta > -r.slope else max(0, counter - 2)
        stop = "flat entropy" if len(history) > r.window and counter >= r.patience * r.window else "discarded objects" if ratios and ratios[-1] > r.most_discarded else "bad masks" if len(history) > r.bad_steps and bad / len(history) > r.bad_share else None
        row.update(step=len(history), entropy=history[-1], delta=delta, smoothed=smooth, counter=counter, stop=stop, bad_masks=bad)
        if stop:
            break
    for b, ratio in zip(boxes, ratios):
        b["row"].update(status=b["status"], discarded=ratio)
    return rows


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        for k, v in w.items():
            assert g.get(k) == (pytest.approx(v, abs=1e-6) if isinstance(v, float) else v), (k, g, w)


def slide(seed, n=9):
    draw = np.random.default_rng(seed)
    base = draw.normal(size=6)
    return [(10 * x + y, x, y, float(draw.uniform(0.05, 1.0)), (base * draw.uniform(0, 1) + draw.normal(size=6) * 0.6).tolist()) for x in range(n) for y in range(n) if draw.uniform() < 0.9], base


@pytest.mark.parametrize("seed, change", [(1, {}), (2, {"window": 2, "patience": 2}), (3, {"flush_every": 2, "overlap": 0.01, "most_discarded": 0.2}), (4, {"bad_steps": 5, "bad_share": 0.05}), (5, {"cluster_size": 30})])
def test_every_step(spark, seed, change):
    rules = miner.Rules(**(RULES.__dict__ | change))
    slides = {f"s{i}": slide(10 * seed + i) for i in range(2)}
    tokens = spark.createDataFrame([(s, *t) for s, (rows, _) in slides.items() for t in rows], "slide string, token long, tok_x int, tok_y int, w double, emb array<double>")
    protos = spark.createDataFrame([(s, q.tolist()) for s, (_, q) in slides.items()] + [("none", [1.0])], "slide string, query array<double>")
    got = miner.mine(tokens, protos, mining_queries.propose, rules).orderBy("slide", "peak").collect()
    for s, (rows, q) in slides.items():
        same([r.asDict() for r in got if r.slide == s], plain(rows, q, mining_queries.propose, rules))


def test_query_is_the_loop_on_every_slide(spark):
    got = registry.QUERIES["w12_mining_loop"](spark, "/root/testdata/sf0.001").collect()
    assert {r.outcome for r in got} >= {"visited", "bad mask", "object", "low confidence"} and {r.status for r in got} >= {"new", "discarded", "pending"}
    assert len({r.slide for r in got}) == 10 and any(r.frozen for r in got) and any(r.stop for r in got)


def test_slides_without_tokens_or_prototype(spark):
    tokens = spark.createDataFrame([("a", 1, 0, 0, 0.5, [1.0]), ("b", 1, None, 0, 0.5, [1.0])], "slide string, token long, tok_x int, tok_y int, w double, emb array<double>")
    protos = spark.createDataFrame([("b", [1.0]), ("c", [1.0])], "slide string, query array<double>")
    assert miner.mine(tokens, protos, mining_queries.propose).count() == 0
