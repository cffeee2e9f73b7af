"""Mining of objects from token similarity: attention, prototypes, maps.  The loop itself is in ``miner``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veridian.functions.vectors import dot
from veridian.sources.stages import forget, written


def token_pool(objects: DataFrame, tokens: DataFrame, key: str, slide: str = "slide") -> DataFrame:
    """Token vectors of each object's token list."""
    each = objects.select(key, slide, F.posexplode("token_idx").alias("place", "token"))
    return each.join(tokens, [slide, "token"])


def grid_lookup(points: DataFrame, tokens: DataFrame, stride: int = 14) -> DataFrame:
    """Tokens under pixel points by grid place; points outside the grid go."""
    cell = points.select("*", F.floor(F.col("x") / stride).alias("tok_x"), F.floor(F.col("y") / stride).alias("tok_y"))
    return cell.join(tokens, ["slide", "tok_x", "tok_y"]).dropDuplicates(["slide", "id", "tok_x", "tok_y"])


def attention_pool(tokens: DataFrame, queries: DataFrame, key: str, size: int) -> DataFrame:
    """Pooled vector of each object: softmax over its tokens for each query (/ sqrt of the length), mean over queries, normalised; and its cosine to the mean query (V7).

    ``queries`` (query_id, query) is a handful of rows.
    """
    pairs = tokens.select(key, "emb").join(F.broadcast(queries), F.lit(True))
    by = W.partitionBy(key, "query_id")
    logit = dot(F.col("emb"), F.col("query")) / np.sqrt(size)
    pairs = pairs.withColumn("_l", logit).withColumn("_e", F.exp(F.col("_l") - F.max("_l").over(by))).withColumn("_w", F.col("_e") / F.sum("_e").over(by))
    pooled = pairs.groupBy(key).agg(F.array(*[F.sum(F.col("_w") * F.col("emb")[i]) / F.count_distinct("query_id") for i in range(size)]).alias("pooled"))
    mean = queries.agg(F.array(*[F.avg(F.col("query")[i]) for i in range(size)]).alias("mean"))
    norm = lambda v: F.sqrt(dot(v, v)) + F.lit(1e-8)
    out = pooled.join(F.broadcast(mean), F.lit(True))
    return out.select(key, F.transform("pooled", lambda x: x / norm(F.col("pooled"))).alias("pooled"), (dot(F.col("pooled"), F.col("mean")) / (norm(F.col("pooled")) * norm(F.col("mean")))).alias("attention"))


def top_tokens(tokens: DataFrame, queries: DataFrame, key: str, token: str, k: int) -> DataFrame:
    """The k tokens of each object that are most similar to any query, ties to the smaller token (O2).

    ``queries`` (query_id, query) is a handful of rows; only the best k of each object leave a task.
    """
    best = tokens.join(F.broadcast(queries), F.lit(True)).groupBy(key, token).agg(F.round(F.max(dot(F.col("emb"), F.col("query"))), 9).alias("similarity"))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("similarity"), token))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k)


def aggregate_maps(cells: DataFrame, by: tuple[str, ...] = ("y", "x"), value: str = "w") -> DataFrame:
    """Largest, mean and median value of each place over all maps or images."""
    return cells.groupBy(*by).agg(F.max(value).alias("largest"), F.avg(value).alias("mean"), F.median(value).alias("median"))


def mask_axes(pixels: DataFrame, key: str) -> DataFrame:
    """Minor and major axis of the ellipse with a mask's second moments: four roots of the eigenvalues of its (population) covariance."""
    m = pixels.groupBy(key).agg(F.var_pop("x").alias("_a"), F.var_pop("y").alias("_b"), F.covar_pop("x", "y").alias("_c"))
    middle, spread = (F.col("_a") + F.col("_b")) / 2, F.sqrt(F.pow((F.col("_a") - F.col("_b")) / 2, 2) + F.pow("_c", F.lit(2)))
    axis = lambda e: 4.0 * F.sqrt(F.greatest(e, F.lit(0.0)))
    return m.select(key, axis(middle - spread).alias("minor"), axis(middle + spread).alias("major"))


def vector_moments(vectors: DataFrame, group: str, vector: str, size: int) -> DataFrame:
    """``group``, ``place``, ``sums``: component sums of each group's vectors (place -1, the count last) and the rows of the sum of their outer products.

    Every task adds up its own batches, so what is shuffled is ``size`` + 1 rows for each group and task, however many
    vectors there are, and those are summed in parts as well.  Missing vectors, other lengths and NaN take no part.
    """
    kind = dict(vectors.dtypes)[group]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[object, np.ndarray] = {}
        for batch in batches:
            keys, lists = batch.column(0), batch.column(1)
            for key in keys.unique().to_pylist():
                own = lists.filter(pc.is_null(keys) if key is None else pc.equal(keys, key).fill_null(False))
                own = own.filter(pc.equal(pc.list_value_length(own), size).fill_null(False))
                x = np.array(own.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, size)
                x = x[np.isfinite(x).all(axis=1)]
                x = np.column_stack([x, np.ones(len(x))])
                sums[key] = sums.get(key, 0.0) + x.T @ x
        for key, total in sums.items():
            rows = np.concatenate([total[-1:], total[:-1]])
            yield pa.record_batch([pa.array([key] * len(rows), keys.type), pa.array(range(-1, size), pa.int32()), pa.array(list(rows), pa.list_(pa.float64()))], names=[group, "place", "sums"])

    parts = vectors.select(group, vector).mapInArrow(run, f"`{group}` {kind}, place int, sums array<double>")
    return parts.groupBy(group, "place").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(size + 1)]).alias("sums"))


def principal_directions(vectors: DataFrame, group: str, vector: str, size: int, k: int = 3) -> DataFrame:
    """``direction``, ``share``, ``members`` of each group: its first ``k`` principal components, each turned towards the mean, summed by eigenvalue and normalised, and their share of the variance (V6).

    A group is decomposed from its moments, of one size; its vectors are never gathered.  Without variance the direction is the
    normalised mean and the share 0; groups without vectors are left out.
    """
    kind = dict(vectors.dtypes)[group]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        rows = np.stack(part.sort_values("place")["sums"].to_list())
        n = rows[0, -1]
        if not n:
            return pd.DataFrame({group: [], "direction": [], "share": [], "members": []}, dtype=object)
        mean = rows[0, :-1] / n
        scatter = rows[1:, :-1] - n * np.outer(mean, mean)
        value, component = np.linalg.eigh(scatter)
        value, component = np.maximum(value[::-1], 0.0), component[:, ::-1].T
        total = value.sum()
        if total <= 1e-12 * max(1.0, float(np.trace(rows[1:, :-1]))):
            direction, share = mean, 0.0
        else:
            turned = component[:k] * np.where(component[:k] @ mean < 0, -1.0, 1.0)[:, None]
            direction, share = value[:k] @ turned, float(value[:k].sum() / total)
        length = np.linalg.norm(direction)
        return pd.DataFrame({group: part[group].iloc[:1], "direction": [(direction / length if length else direction).tolist()], "share": [share], "members": [int(n)]})

    return vector_moments(vectors, group, vector, size).groupBy(group).applyInPandas(run, f"`{group}` {kind}, direction array<double>, share double, members long")


def refine_prototypes(vectors: DataFrame, start: DataFrame, group: str, key: str, vector: str, size: int, share: float = 0.25, rounds: int = 100, tolerance: float = 1e-4, bins: int = 4096) -> DataFrame:
    """``group``, ``prototype``, ``rounds``: the medoid of each group's best ``share`` of unit vectors, taken again from there until it stays.

    All groups go on together and each round is a written table.  The best are found by a histogram of the scores: whole
    bins above the cut are taken by counting, and only the bin with the cut is ranked (ties to the smaller key).  For unit vectors the
    medoid has the largest product with the sum of the best, so no pairs are made.  ``start``: group, prototype.
    """
    rows = vectors.select(group, F.col(key).alias("_key"), F.col(vector).cast("array<double>").alias("_v")).filter("_v is not null")
    keep = rows.groupBy(group).agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * share)).cast("long").alias("_keep"))
    state = written(start.select(group, F.col("prototype").cast("array<double>").alias("prototype"), F.lit(0).alias("rounds"), F.lit(True).alias("moving")).join(keep, group), "prototypes")
    for _ in range(rounds):
        if state.filter("moving").isEmpty():
            break
        scored = rows.join(state.filter("moving").select(group, "prototype", "_keep"), group).withColumn("_s", F.round(dot(F.col("_v"), F.col("prototype")), 9))
        scored = scored.withColumn("_bin", F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("_s") + 1) / 2 * bins))).cast("int"))
        counts = scored.groupBy(group, "_bin").agg(F.count(F.lit(1)).alias("_n"), F.first("_keep").alias("_keep"))
        above = F.sum("_n").over(W.partitionBy(group).orderBy(F.desc("_bin"))) - F.col("_n")
        cut = counts.withColumn("_above", above).filter("_above < _keep and _above + _n >= _keep").select(group, F.col("_bin").alias("_cut"), (F.col("_keep") - F.col("_above")).alias("_need"))
        near = scored.join(cut, group)
        whole = near.filter(F.col("_bin") > F.col("_cut"))
        edge = near.filter(F.col("_bin") == F.col("_cut"))
        ranked = edge.select(group, "_key", "_s", "_need").withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(F.desc("_s"), "_key"))).filter("_r <= _need").select(group, "_key")
        best = written(whole.select(group, "_key", "_v", "_s").unionByName(edge.join(ranked, [group, "_key"], "left_semi").select(group, "_key", "_v", "_s")), "best")
        total = best.groupBy(group).agg(F.array(*[F.sum(F.col("_v")[i]) for i in range(size)]).alias("_t"))
        medoid = best.join(total, group).withColumn("_m", F.round(dot(F.col("_v"), F.col("_t")), 9))
        medoid = medoid.groupBy(group).agg(F.min(F.struct((-F.col("_m")).alias("m"), (-F.col("_s")).alias("s"), F.col("_key").alias("k"), F.col("_v").alias("v"))).alias("_best"))
        length = F.sqrt(dot(F.col("_best.v"), F.col("_best.v"))) + F.lit(1e-8)
        now = state.join(medoid.select(group, F.transform("_best.v", lambda x: x / length).alias("_now")), group, "left")
        gap = F.sqrt(F.aggregate(F.zip_with("_now", "prototype", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x))
        now = now.select(group, F.coalesce("_now", "prototype").alias("prototype"), (F.col("rounds") + F.col("moving").cast("int")).alias("rounds"), (F.col("moving") & (gap >= tolerance)).alias("moving"), "_keep")
        before, state = state, written(now, "prototypes")
        forget(before, best)
    return state.select(group, "prototype", "rounds")


def smooth(cells: DataFrame, sigma: float = 1.0, radius: int = 4) -> DataFrame:
    """Separable Gaussian smoothing of (slide, y, x, w) on a dense map, edges reflected."""
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weights = weights / weights.sum()
    kernel = F.array(*[F.struct(F.lit(int(d)).alias("d"), F.lit(float(w)).alias("k")) for d, w in zip(range(-radius, radius + 1), weights)])
    out = cells
    for axis in ("x", "y"):
        last = out.groupBy("slide").agg(F.max(axis).alias("_n"))
        spread = out.join(F.broadcast(last), "slide").withColumn("_k", F.explode(kernel))
        at = F.col(axis) + F.col("_k.d")
        period = 2 * (F.col("_n") + 1)
        turned = F.pmod(at, period)
        back = F.when(turned > F.col("_n"), period - 1 - turned).otherwise(turned)
        other = "y" if axis == "x" else "x"
        out = spread.groupBy("slide", other, back.cast("int").alias(axis)).agg(F.sum(F.col("w") * F.col("_k.k")).alias("w")).select("slide", "y", "x", "w")
    return out


def expected_entropy_drop(cells: DataFrame, key: str, n: int) -> DataFrame:
    """Entropy of each object's n largest cells, and the drop if their mass left the map of entropy ``total``."""
    top = cells.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("w"), "y", "x"))).filter(F.col("_r") <= n)
    agg = top.groupBy(key).agg(F.sum("w").alias("p"), F.sum(-F.col("w") * F.log(F.col("w") + 1e-10)).alias("h"), F.first("total").alias("total"))
    return agg.select(key, "p", "h", (-F.col("h") + F.col("p") * (F.log(1 - F.col("p") + 1e-10) - F.col("total"))).alias("drop"))
