"""Bounded labelled samples and the logistic curve that the classifiers of this package share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights (the first: constant) of a penalised logistic regression, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + l2 * len(x) / 100 * np.eye(len(w)),
                               x.T @ (y - p) - l2 * len(x) / 100 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
                    per_class: tuple[int, int], chars: tuple[int, int]) -> list[tuple[str, int]]:
    """Whole labelled texts, at most ``per_class`` (label 1, label 0) different (id, text) rows and ``chars`` characters
    of each label: in the order of their ids' hash, passing over a text that is longer than what is left.

    The first job finds the rows by id, hash and length alone; only the chosen texts are collected, once each.
    """
    key, body = F.col(id_col).cast("string"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(key.alias("key"), body.alias("body")).withColumn("digest", F.xxhash64("body"))
    narrow = rows.select("key", "digest", F.length("body").alias("size"))
    order = F.xxhash64("key")
    kept = []
    for y, most, room in ((1, per_class[0], chars[0]), (0, per_class[1], chars[1])):
        marked = labels.where(F.col(label_col) == y).select(key.alias("key")).distinct()
        found = narrow.where(F.col("size") <= room).join(marked, "key").distinct().orderBy(order, "key", "digest").limit(most)
        for r in found.collect():  # at most per_class
            if r["size"] <= room:
                room -= r["size"]
                kept.append((r["key"], r["digest"], y))
    if not kept:
        return []
    # the sample's keys are bounded by per_class
    chosen = docs.sparkSession.createDataFrame(kept, "key string, digest long, y int")
    texts = rows.join(F.broadcast(chosen), ["key", "digest"]).dropDuplicates(["key", "digest", "y"]).select(
        order.alias("o"), "body", "y").collect()
    return [(r.body, r.y) for r in sorted(texts, key=lambda r: (r.o, r.body, r.y))]
