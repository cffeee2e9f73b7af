"""Column functions over array<double> vectors; Spark has no built-in ones, so they are folds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-8


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalized(a: Column) -> Column:
    """Zero vectors stay as they are (V2)."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def cosine(a: Column, b: Column) -> Column:
    """Dot product of vectors normalised with a small constant (V1)."""
    return dot(a, b) / ((norm(a) + EPSILON) * (norm(b) + EPSILON))


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    """V3."""
    if metric == "cosine":
        return 1.0 - cosine(a, b)
    if metric == "euclidean":
        return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    raise ValueError(f"no such metric: {metric}")


def fused(image: Column, text: Column, alpha: float) -> Column:
    """Late fusion of two similarities (V5)."""
    return alpha * image + (1 - alpha) * text


def concatenated(image: Column, text: Column, size: int) -> Column:
    """Image and text features side by side, zeros where there is no text."""
    return F.concat(image, F.coalesce(text, F.array_repeat(F.lit(0.0), size)))


def softmax(a: Column, temperature: float = 1.0) -> Column:
    """V11."""
    e = F.transform(a, lambda x: F.exp((x - F.array_max(a)) / temperature))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def argmax(a: Column) -> Column:
    """Position of the first largest value, from 0."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def distillation_loss(student: Column, teacher: Column, label: Column, alpha: float = 0.5, temperature: float = 3.0) -> Column:
    """(1 - alpha) cross-entropy + alpha T^2 KL(teacher || student)."""
    p, q = softmax(teacher, temperature), softmax(student, temperature)
    kl = F.aggregate(F.zip_with(p, q, lambda x, y: x * (F.log(x) - F.log(y))), F.lit(0.0), lambda s, x: s + x)
    return (1 - alpha) * -F.log(F.element_at(softmax(student), label + 1)) + alpha * temperature * temperature * kl


def element_sums(v: str = "embedding", size: int = 64) -> list[Column]:
    """Aggregates that sum a fixed-length vector by component: partial sums, no explode."""
    return [F.sum(F.col(v)[i]).alias(f"s{i}") for i in range(size)]


def mean_vector(v: str = "embedding", size: int = 64) -> Column:
    """Component-wise mean as an aggregate."""
    return F.array(*[F.avg(F.col(v)[i]) for i in range(size)])
