"""Queries on the fixture tables and their SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import answers, enriched, graphs, ingest, lists, records, served, streams
from .queries import ORACLE, QUERIES, rrf_fusion

__all__ = ["ORACLE", "QUERIES", "answers", "enriched", "entry", "graphs", "ingest", "lists", "records", "served", "streams"]


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: hybrid retrieval, two routes fused by rank."""
    return rrf_fusion(spark, sf_dir)
