"""The mining loop over a similarity map: one row for each peak that is looked at (W12, with O1, F3-F5, W1-W7, W9-W11).

A slide's loop is a fold over its own map, which every accepted object changes, so a slide is one group of
``applyInPandas`` and slides run beside each other.  What a group holds is the slide's tokens and prototype.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridian.operators.nms import greedy

EPSILON = 1e-10

#: A mask for a peak at pixel (x, y): box x1, y1, x2, y2 and area.
Propose = Callable[[int, int], tuple[int, int, int, int, int]]

STEPS = (
    "slide string, peak int, token long, step int, outcome string, entropy double, delta double, smoothed double, counter int, confidence double, smoothed_confidence double, "
    "members int, frozen boolean, bad_masks int, status string, discarded double, x1 int, y1 int, x2 int, y2 int, stop string"
)


@dataclass(frozen=True)
class Rules:
    """Limits of the loop."""

    percentile: float = 90.0
    stride: int = 14
    mask_area: tuple[float, float] = (0.0, float("inf"))
    box_area: tuple[float, float] = (0.0, float("inf"))
    floor: float = 1e-3  # what a bad mask leaves of its peak
    least_confidence: float = 0.5
    cluster_confidence: float = 0.7
    cluster_size: int = 100
    flush_every: int = 200
    overlap: float = 0.3
    window: int = 100
    slope: float = 1e-4  # entropy lost per window that counts as flat
    patience: int = 5
    bad_share: float = 0.5
    bad_steps: int = 10_000
    most_discarded: float = 0.8


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    return float((a / (np.linalg.norm(a) + 1e-8)) @ (b / (np.linalg.norm(b) + 1e-8)))


@dataclass
class Cluster:
    """The most confident members and their mean, until it is steady.

    The first mean is compared with the prototype; ``size`` // 10 steady means in a row, or a full reservoir, freeze it.
    """

    mean: np.ndarray
    size: int
    held: list = field(default_factory=list)
    steady: int = 0
    frozen: bool = False

    def offer(self, confidence: float, vector: np.ndarray, place: int) -> None:
        if self.frozen:
            return
        if len(self.held) < self.size:
            heapq.heappush(self.held, (confidence, place, vector))
        elif confidence > self.held[0][0]:
            heapq.heapreplace(self.held, (confidence, place, vector))
        else:
            return
        mean = np.mean([v for *_, v in self.held], axis=0)
        self.steady = self.steady + 1 if cosine(mean, self.mean) > 0.999 else 0
        self.mean = mean
        self.frozen = self.steady >= self.size // 10 or len(self.held) == self.size


@dataclass
class Suppression:
    """Objects of the run: every ``every`` of them the held and the new ones are suppressed together."""

    every: int
    overlap: float
    boxes: list = field(default_factory=list)
    scores: list = field(default_factory=list)
    status: list = field(default_factory=list)
    discarded: list = field(default_factory=list)
    held: list = field(default_factory=list)
    flushed: int = 0
    average: float | None = None

    def add(self, box: tuple, score: float) -> None:
        self.boxes.append(box)
        self.scores.append(score)
        self.status.append("pending")
        self.discarded.append(self.discarded[-1] if self.discarded else 0.0)
        if len(self.boxes) - self.flushed >= self.every:
            self._flush()

    def _flush(self) -> None:
        fresh = list(range(self.flushed, len(self.boxes)))
        pool = sorted(self.held + fresh, key=lambda i: (-self.scores[i], i))
        stay = greedy(np.array([self.boxes[i] for i in pool], dtype=np.float64), self.overlap)
        kept = [i for i, keep in zip(pool, stay) if keep]
        lost = len(set(self.held) - set(kept))
        new = [i for i in kept if i >= self.flushed]
        for i in fresh:
            self.status[i] = "discarded"
        for n, i in enumerate(new):  # best first: as many replacements as held objects went
            self.status[i] = "replacement" if n < lost else "new"
        share = Counter(self.status)["discarded"] / len(self.status)
        self.average = share if self.average is None else 0.9 * self.average + 0.1 * share
        self.discarded[self.flushed :] = [self.average] * len(fresh)
        self.held, self.flushed = sorted(kept), len(self.boxes)


def run_slide(tokens: pd.DataFrame, prototype: np.ndarray, propose: Propose, rules: Rules) -> list[dict]:
    """The loop over the tokens (token, tok_x, tok_y, w, emb) of one slide; a dictionary for each peak."""
    wide, high = int(tokens["tok_x"].max()) + 1, int(tokens["tok_y"].max()) + 1
    tx, ty = tokens["tok_x"].to_numpy(), tokens["tok_y"].to_numpy()
    similarity, row = np.zeros((high, wide)), np.full((high, wide), -1)
    similarity[ty, tx], row[ty, tx] = tokens["w"].to_numpy(np.float64), np.arange(len(tokens))
    vectors = np.stack(tokens["emb"].to_list()).astype(np.float64)
    visited = np.zeros((high, wide), dtype=bool)
    peaks = tokens[tokens["w"] >= np.percentile(tokens["w"], rules.percentile)].sort_values(["w", "token"], ascending=[False, True])

    cluster, objects = Cluster(prototype, rules.cluster_size), Suppression(rules.flush_every, rules.overlap)
    entropies: list[float] = []
    smoothed = confidence_average = None
    steps = counter = bad_masks = 0
    out: list[dict] = []

    def logged(line: dict, old: np.ndarray, new: float | np.ndarray = 0.0) -> bool:
        """Entropy, counter and stop rules of a step; whether mining stops."""
        nonlocal smoothed, counter, steps
        if entropies:
            change = old * np.log(old + EPSILON) - new * np.log(new + EPSILON)
            entropies.append(entropies[-1] + float(np.sum(change)))
        else:
            entropies.append(float(-np.sum(similarity * np.log(similarity + EPSILON))))
        delta = entropies[-1] - entropies[-rules.window - 1] if len(entropies) > rules.window else 0.0
        smoothed = delta if smoothed is None else 0.99 * smoothed + 0.01 * delta
        if steps > rules.window:
            counter = counter + 1 if delta > -rules.slope else max(counter - 2, 0) if delta < -rules.slope else counter
        steps += 1
        stop = None
        if steps > rules.window and counter >= rules.patience * rules.window:
            stop = "flat entropy"
        elif objects.discarded and objects.discarded[-1] > rules.most_discarded:
            stop = "discarded objects"
        elif steps > rules.bad_steps and bad_masks / steps > rules.bad_share:
            stop = "bad masks"
        line.update(step=steps, entropy=entropies[-1], delta=delta, smoothed=smoothed, counter=counter, stop=stop)
        return stop is not None

    for r in peaks.itertuples(index=False):
        line = {"peak": len(out), "token": r.token, "members": len(cluster.held), "frozen": cluster.frozen, "bad_masks": bad_masks}
        out.append(line)
        if visited[r.tok_y, r.tok_x]:
            line["outcome"] = "visited"
            if logged(line, np.zeros(0)):
                break
            continue
        x1, y1, x2, y2, area = propose(r.tok_x * rules.stride + rules.stride // 2, r.tok_y * rules.stride + rules.stride // 2)
        line.update(x1=x1, y1=y1, x2=x2, y2=y2)
        size = (x2 - x1 + 1) * (y2 - y1 + 1) if area else 0
        if not (rules.mask_area[0] <= area <= rules.mask_area[1] and rules.box_area[0] <= size <= rules.box_area[1]):
            visited[r.tok_y, r.tok_x] = True
            old = similarity[r.tok_y, r.tok_x]
            similarity[r.tok_y, r.tok_x] = rules.floor
            bad_masks += 1
            line.update(outcome="bad mask", bad_masks=bad_masks)
            if logged(line, np.array([old]), np.array([rules.floor])):
                break
            continue
        # slices end at the border of the grid
        area_of = (slice(max(y1 // rules.stride, 0), max(y2 // rules.stride + 1, 0)), slice(max(x1 // rules.stride, 0), max(x2 // rules.stride + 1, 0)))
        own = row[area_of]
        own = own[own >= 0]
        mean = vectors[own].mean(axis=0) if len(own) else None
        if mean is None or np.isnan(mean).any():
            line["outcome"] = "no tokens"
            continue
        confidence = cosine(mean, cluster.mean)
        if confidence > rules.cluster_confidence:
            cluster.offer(confidence, mean, len(out))
        line.update(confidence=confidence, members=len(cluster.held), frozen=cluster.frozen)
        if confidence < rules.least_confidence:
            line["outcome"] = "low confidence"
            continue
        old = similarity[area_of].ravel().copy()
        visited[area_of], similarity[area_of] = True, 0.0
        objects.add((x1, y1, x2, y2), confidence)
        confidence_average = confidence if confidence_average is None else 0.9 * confidence_average + 0.1 * confidence
        line.update(outcome="object", smoothed_confidence=confidence_average, _object=len(objects.boxes) - 1)
        if logged(line, old):
            break
    for line in out:
        if "_object" in line:
            i = line.pop("_object")
            line.update(status=objects.status[i], discarded=objects.discarded[i])
    return out


def mine(tokens: DataFrame, prototypes: DataFrame, propose: Propose, rules: Rules = Rules()) -> DataFrame:
    """STEPS of every slide of ``tokens`` (slide, token, tok_x, tok_y, w, emb) with its ``prototypes`` (slide, query).

    Peaks are the tokens at or above the percentile of the slide's own weights, best first, ties to the smaller token.
    A row's ``step`` is null where the loop goes on without one: no token under the mask, or too little confidence.
    ``status`` and ``discarded`` (the moving average of the discarded share) are those after the last flush; what comes
    after it is pending.  Slides without a prototype, and tokens without a place or weight, take no part.
    """
    names = [f.split()[0] for f in STEPS.split(", ")]
    whole = {"peak": "int32", "step": "Int32", "counter": "Int32", "members": "int32", "bad_masks": "int32", "x1": "Int32", "y1": "Int32", "x2": "Int32", "y2": "Int32", "token": "int64"}

    def run(part: pd.DataFrame, proto: pd.DataFrame) -> pd.DataFrame:
        part = part.dropna(subset=["tok_x", "tok_y", "w"])
        rows = run_slide(part, np.array(proto["query"].iloc[0], dtype=np.float64), propose, rules) if len(part) and len(proto) else []
        frame = pd.DataFrame(rows, columns=names)
        frame["slide"] = str(part["slide"].iloc[0]) if len(rows) else None
        return frame.astype(whole | {"frozen": "boolean"} | dict.fromkeys(("slide", "outcome", "status", "stop"), object))

    each = tokens.select("slide", "token", "tok_x", "tok_y", "w", "emb").groupBy("slide")
    return each.cogroup(prototypes.select(F.col("slide").alias("_slide"), "query").groupBy("_slide")).applyInPandas(run, STEPS)
