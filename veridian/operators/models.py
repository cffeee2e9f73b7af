"""Model steps as pluggable functions with deterministic stand-ins (no weights are part of this repository)."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame


def hashed_vectors(texts: list[str], size: int = 384) -> np.ndarray:
    """Stand-in for an embedding model: a unit vector from the hash of the text (M1, M4)."""
    seeds = [int.from_bytes(hashlib.blake2b((t or "").encode(), digest_size=8).digest(), "little") for t in texts]
    x = np.stack([np.random.default_rng(s).normal(size=size) for s in seeds]) if texts else np.zeros((0, size))
    return x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x


def template_caption(prompt: str) -> str:
    """Stand-in for a captioning model (M5)."""
    return f"A grain. {prompt.splitlines()[0] if prompt else ''}".strip()


def classifier_gate(rows: DataFrame, background: int = 51, least: float = 0.5, keep_background: bool = False) -> DataFrame:
    """Rows with ``class_prob`` at least ``least`` whose class is not the background (F8)."""
    sure = rows.filter(rows["class_prob"] >= least)
    return sure if keep_background else sure.filter(sure["class_id"] != background)
