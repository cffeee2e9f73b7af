"""Query construction for retrieval, and evaluation within and across regions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridian.operators.metrics import overall


def build_queries(corpus: DataFrame, exemplars: DataFrame, image: DataFrame, text: DataFrame, excluded: DataFrame) -> DataFrame:
    """slide, species, origin, n_grains, img_emb, txt_emb of the slides that may be queries.

    A query is a slide of ``exemplars`` (slide) that is in ``corpus`` (slide, species, origin, key), is not ``excluded`` (slide)
    and has an image or a text vector (slide, emb).  Other slides never are, whatever vectors they have.  A slide's
    species and origin come from its first corpus row by key.
    """
    asked = exemplars.select("slide").distinct().join(excluded.select("slide").distinct(), "slide", "left_anti")
    info = corpus.join(asked, "slide", "left_semi").groupBy("slide").agg(F.min_by(F.struct("species", "origin"), "key").alias("_i"), F.count(F.lit(1)).alias("n_grains"))
    rows = info.select("slide", "_i.species", "_i.origin", "n_grains")
    rows = rows.join(image.select("slide", F.col("emb").alias("img_emb")), "slide", "left").join(text.select("slide", F.col("emb").alias("txt_emb")), "slide", "left")
    return rows.filter("img_emb is not null or txt_emb is not null")


def active_queries(queries: DataFrame, modality: str) -> DataFrame:
    """Queries with the vectors that a modality needs: image, text, or both for combined."""
    need = {"image": ["img_emb"], "text": ["txt_emb"], "combined": ["img_emb", "txt_emb"]}[modality]
    return queries.filter(" and ".join(f"{c} is not null" for c in need))


def sibling_representatives(queries: DataFrame, siblings: DataFrame, modality: str, mode: str) -> DataFrame:
    """The first slide of each set of siblings (E5): for image and combined queries, but not in mode ``all``.

    ``siblings`` (slide, sibling) holds both directions.  Two slides are of one set if each has the same siblings,
    itself included.
    """
    if modality == "text" or mode == "all":
        return queries
    own = queries.select("slide").join(siblings.select("slide", "sibling").distinct(), "slide", "left")
    sets = own.groupBy("slide").agg(F.array_sort(F.array_distinct(F.array_append(F.collect_list("sibling"), F.first("slide")))).alias("_set"))
    first = sets.groupBy("_set").agg(F.min("slide").alias("slide"))
    return queries.join(first.select("slide"), "slide", "left_semi")


def text_representatives(queries: DataFrame, relevant: DataFrame, mode: str) -> DataFrame:
    """Text queries once for each species, or species and origin in mode ``cross_regional``.

    ``relevant`` (slide, n_relevant) counts what is left after exclusion; queries without any go first, so they
    represent nothing.  The first slide of each key stays.
    """
    by = ["species", "origin"] if mode == "cross_regional" else ["species"]
    left = queries.join(relevant.filter("n_relevant > 0").select("slide"), "slide", "left_semi")
    return queries.join(left.groupBy(*by).agg(F.min("slide").alias("slide")).select("slide"), "slide", "left_semi")


def slides_of(corpus: DataFrame) -> DataFrame:
    """slide, species (of its first key), n of a corpus (slide, species, key)."""
    return corpus.groupBy("slide").agg(F.min_by("species", "key").alias("species"), F.count(F.lit(1)).alias("n"))


def pool_composition(searched: DataFrame, query: Sequence[str]) -> DataFrame:
    """For each query, the slides it searched with species, rows and whether they are its target.

    ``searched`` has (query columns, slide, species, n, excluded, target): every slide of the corpus (:func:`slides_of`) for every query.
    """
    kept, is_target = ~F.col("excluded"), F.col("species") == F.col("target")
    return searched.groupBy(*query).agg(
        F.sum(F.when(kept, F.col("n")).otherwise(0)).alias("n_corpus_searched"),
        F.sum(F.when(~kept, F.col("n")).otherwise(0)).alias("n_excluded"),
        F.count_if(kept).alias("n_probed_slides"),
        F.array_sort(F.collect_list(F.when(~kept, F.col("slide")))).alias("excluded_slides"),
        F.array_sort(F.collect_list(F.when(kept & is_target, F.col("slide")))).alias("target_slides"),
        F.array_sort(F.collect_list(F.when(kept, F.struct("slide", "species", "n", is_target.alias("is_target"))))).alias("pool_composition"),
    )


def mean_relevant(metrics: DataFrame, by: str, total: str = "total") -> DataFrame:
    """Mean number of relevant rows of a group's queries, cut to a whole number."""
    return metrics.filter(F.col(total).isNotNull()).groupBy(by).agg(F.avg(total).cast("int").alias("mean_relevant"))


def preview(ranked: DataFrame, query: Sequence[str], k: int = 10) -> DataFrame:
    """The first k species and scores of each ranking."""
    top = ranked.filter(F.col("rank") <= k)
    rows = F.array_sort(F.collect_list(F.struct("rank", "species", F.round("score", 5).alias("score"))))
    return top.groupBy(*query).agg(F.transform(rows, lambda r: r["species"]).alias("top_species"), F.transform(rows, lambda r: r["score"]).alias("top_scores"))


def training_species(matrix: DataFrame, region: str) -> DataFrame:
    """Lower-case species of a region's ``matrix`` rows (dataset, species), of all for ``all``; none for an unknown region."""
    rows = matrix if region == "all" else matrix.filter(F.col("dataset") == region)
    return rows.select(F.lower("species").alias("species")).distinct()


def region_overlap(matrix: DataFrame) -> DataFrame:
    """source, target, species (lower case), side for each ordered pair of regions: both, train or test only."""
    rows = matrix.select("dataset", F.lower("species").alias("species")).distinct()
    names = rows.select("dataset").distinct()
    # pairs of regions: a handful of names
    pairs = names.select(F.col("dataset").alias("source")).crossJoin(names.select(F.col("dataset").alias("target"))).filter("source <> target")
    held = pairs.join(rows.withColumnRenamed("dataset", "source"), "source").withColumn("in_source", F.lit(1))
    other = pairs.join(rows.withColumnRenamed("dataset", "target"), "target").withColumn("in_target", F.lit(1))
    both = held.join(other.select("source", "target", "species", "in_target"), ["source", "target", "species"], "full_outer")
    side = F.when(F.col("in_target").isNull(), "train only").when(F.col("in_source").isNull(), "test only").otherwise("both")
    return both.select("source", "target", "species", side.alias("side"))


def overlap_flags(samples: DataFrame, overlap: DataFrame, source: str) -> DataFrame:
    """``samples`` (target, species, ...) with ``in_overlap`` for a model trained on ``source``: all where target and source agree."""
    known = overlap.filter((F.col("source") == source) & (F.col("side") == "both")).select("target", F.col("species").alias("_s"), F.lit(True).alias("_in"))
    joined = samples.join(known, (samples["target"] == known["target"]) & (F.lower(samples["species"]) == F.col("_s")), "left").drop(known["target"])
    return joined.withColumn("in_overlap", (F.col("target") == source) | F.coalesce("_in", F.lit(False))).drop("_s", "_in")


def subset_metrics(predictions: DataFrame) -> DataFrame:
    """Classification metrics of all rows (label, pred, in5, in_overlap) and of those in the overlap; ``note`` where there are none."""
    every = overall(predictions, top5="in5").withColumn("subset", F.lit("all"))
    some = overall(predictions.filter("in_overlap"), top5="in5").withColumn("subset", F.lit("overlap"))
    note = F.when(F.coalesce("samples", F.lit(0)) == 0, F.concat(F.lit("No "), "subset", F.lit(" samples")))
    return every.unionByName(some).withColumn("note", note)


def evaluation_targets(overlap: DataFrame, matrix: DataFrame, source: str) -> DataFrame:
    """target, position, overlap_taxa: the regions to evaluate a model of ``source`` on, itself first, those without shared taxa left out."""
    shared = overlap.filter((F.col("source") == source) & (F.col("side") == "both")).groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    own = matrix.filter(F.col("dataset") == source).select(F.col("dataset").alias("target")).distinct().withColumn("position", F.lit(0)).withColumn("overlap_taxa", F.lit("all"))
    return own.union(shared.select("target", F.lit(1).alias("position"), F.col("n").cast("string").alias("overlap_taxa")))
