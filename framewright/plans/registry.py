"""Collects the queries and the oracle SQL of all operator families."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from framewright.plans.base import REGISTRY, Views

FAMILIES = ("source_queries", "frame_queries", "region_queries", "curve_queries", "shape_queries", "graph_queries", "composite_queries", "compose_queries", "stream_queries")


def _registered() -> dict:
    for family in FAMILIES:
        importlib.import_module(f"framewright.plans.{family}")
    return REGISTRY


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crop, temporal difference, then mean and deviation for each pixel."""
    from framewright.operators import frames, temporal

    views = Views(spark, sf_dir)
    return temporal.mean_std(temporal.difference(frames.crop(views.pixels8, 1, 2, 4, 5)))


def queries() -> dict:
    return {key: (lambda spark, sf_dir, f=function: f(Views(spark, sf_dir))) for key, (function, _) in _registered().items()}


def oracle_sql() -> dict[str, str]:
    return {key: sql for key, (_, sql) in _registered().items() if sql is not None}
