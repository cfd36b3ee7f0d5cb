"""The queries of this package, with production parameters over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arc, exact, licences, lm, merkle, mixing, near, packing, planes, toxicity
from .common import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copies that every document gets."""
    return mixing.drawn_copies(table(spark, sf_dir, "documents")).drop("key")


def op2_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All token ids as compressed byte planes, a row for each block."""
    return planes.encode_planes(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxic documents with their scores."""
    return toxicity.toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that has exact copies."""
    return exact.exact_copies(table(spark, sf_dir, "documents"))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as sequences of power-of-two lengths."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every licence in every document."""
    return licences.scan(table(spark, sf_dir, "documents"))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model that is trained on all of them."""
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op8_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written as an ARC record, as a WARC record."""
    out = arc.convert(arc.page_records(table(spark, sf_dir, "pages")))
    return out.withColumnRenamed("id", "page_id").withColumn("record", F.decode("record", "UTF-8"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that has near duplicates, with its group and its number of links."""
    return near.near_links(table(spark, sf_dir, "documents"))


def op10_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's root, and where it differs from its base."""
    found = merkle.fingerprints(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.array_join(F.col(c), ",") for c in ("changed_sections", "changed_paragraphs", "removed_paragraphs")})


def op10_merkle_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every document differs from the earlier one that shares most paragraphs with it."""
    found = merkle.partners(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.array_join(F.col(c), ",") for c in ("changed_sections", "changed_paragraphs", "removed_paragraphs")})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
