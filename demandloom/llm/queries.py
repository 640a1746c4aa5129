"""The registered queries of this subpackage, each over its whole table, with SQL where SQL can state the rows."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from demandloom.llm import (
    ann,
    bpe,
    decontaminate,
    html_extract,
    line_dedup,
    merkle,
    minhash,
    mixing,
    quality,
    substring_dedup,
    warc,
    whitening,
)
from demandloom.llm import license as licenses
from demandloom.llm.tables import load

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


class Entry(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


def on(work: Callable[..., DataFrame], *tables: str, sql: str | None = None) -> Entry:
    """A query that hands the named tables to ``work``."""
    return Entry(lambda spark, sf_dir: work(*[load(spark, sf_dir, t) for t in tables]), sql)


def near_duplicate_query(documents: DataFrame) -> DataFrame:
    """doc_id, class_id and n_links of every document."""
    return minhash.near_duplicates(documents).select("doc_id", "class_id", "n_links")


def bpe_query(documents: DataFrame) -> DataFrame:
    return bpe.bpe_digest(documents, RANKS, public_tokenizers.PATTERN)


ENTRIES: dict[str, Entry] = {
    "op1_nearest_neighbours": on(ann.nearest_query, "embeddings", sql=ann.SQL),
    "op2_byte_bpe": on(bpe_query, "documents"),
    "op3_quality": on(quality.quality_scores, "documents", "labels"),
    "op4_licenses": on(licenses.license_query, "documents"),
    "op5_main_text": on(html_extract.extract_main_text, "pages"),
    "op6_line_dedup": on(line_dedup.line_dedup_digest, "documents", sql=line_dedup.SQL),
    "op7_near_duplicates": on(near_duplicate_query, "documents"),
    "op8_passages": on(substring_dedup.passage_digest, "documents", sql=substring_dedup.SQL),
    "op9_decontamination": on(decontaminate.contamination, "documents", "benchmark", sql=decontaminate.SQL),
    "op10_revisits": on(warc.revisit_query, "pages", sql=warc.SQL),
    "op11_whitening": on(whitening.whitened_query, "embeddings"),
    "op12_merkle_manifest": on(merkle.manifest_digest, "documents", sql=merkle.SQL),
    "op13_source_mix": on(mixing.mixture, "documents", sql=mixing.SQL),
}
