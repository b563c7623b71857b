"""Relevance of a file: a weighted sum of five signals, each from 0 to 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import stem

# Weights of the signals, scores of match types, and the half-life of recency in seconds.
WEIGHTS = {"match_type": 0.30, "depth": 0.15, "name": 0.15, "count": 0.25, "recency": 0.15}
MATCH_TYPES = {"exact": 1.0, "prefix": 0.8, "substring": 0.6, "regex": 0.4}
HALF_LIFE = 2_592_000.0


def depth_score(path: Column) -> Column:
    depth = F.size(F.split(path, "/"))
    return F.when(depth >= 10, F.lit(0.0)).otherwise(F.lit(1.0) - depth / F.lit(10.0))


def name_score(path: Column, query: str) -> Column:
    return F.when(F.lower(stem(path)).contains(query.lower()), 1.0).otherwise(0.0)


def count_score(matches: Column, line_count: Column) -> Column:
    raw = F.log(F.lit(1.0) + matches) / F.log(F.lit(1.0) + F.greatest(line_count, F.lit(1)))
    return F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))


def recency_score(mtime: Column, now: int, half_life: float = HALF_LIFE) -> Column:
    if half_life <= 0:
        return F.lit(0.0)
    return F.pow(F.lit(2.0), -F.greatest(F.lit(now) - mtime, F.lit(0)) / F.lit(half_life))


def score(path: Column, matches: Column, line_count: Column, mtime: Column, now: int, query: str = "", match_type: str = "substring") -> Column:
    signals = {"match_type": F.lit(MATCH_TYPES[match_type]), "depth": depth_score(path), "name": name_score(path, query), "count": count_score(matches, line_count), "recency": recency_score(mtime, now)}
    total = sum((signals[k] * F.lit(w) for k, w in WEIGHTS.items()), F.lit(0.0))
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def symbol_score(name: Column, query: str, folded) -> Column:
    own, wanted = folded(name), query.lower()
    return F.when(own == wanted, 1.0).when(own.startswith(wanted), 0.8).otherwise(0.5)
