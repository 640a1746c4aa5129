"""A corpus from documents to token digests, stage by stage.

Every stage reads what its predecessor wrote. All but the last return the columns
of ``documents``; the last returns one row of token digests per document that is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.llm import bpe, decontaminate, line_dedup, minhash, quality
from demandloom.llm.queries import RANKS, public_tokenizers
from demandloom.llm.tables import load, pick, same, stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It learns from the labels of these documents."""
    model = quality.fit(*quality.training_rows(docs, load(spark, sf_dir, "labels")))
    return quality.score_quality(docs.select(*COLUMNS), model).where("predicted = 1").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines stay in their first document only; a document that loses all its lines goes."""
    kept = line_dedup.dedup_lines(docs, carry=("lang", "source"))
    kept = kept.where("n_dropped < n_lines").withColumnRenamed("kept_text", "text")
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class, the first by id and text; of rows that repeat id and text of words, one."""
    found = stage(minhash.near_duplicates(docs).select("doc_id", "text_hash", "kept", "n_rows"))
    marked = docs.withColumn("text_hash", F.xxhash64("text"))
    copies, repeated = found.where("NOT kept"), found.where("kept AND n_rows > 1")
    left = marked.join(copies, same(marked, copies, "doc_id", "text_hash"), "left_anti")
    single = left.join(repeated, same(left, repeated, "doc_id", "text_hash"), "left_anti")
    several = left.join(repeated, same(left, repeated, "doc_id", "text_hash"), "left_semi")
    return single.union(several.dropDuplicates(["doc_id", "text_hash"])).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    hits = decontaminate.find_contamination(docs, load(spark, sf_dir, "benchmark")).select("doc_id", "text_hash")
    marked = docs.withColumn("text_hash", F.xxhash64("text"))
    return marked.join(hits, same(marked, hits, "doc_id", "text_hash"), "left_anti").select(*COLUMNS)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes."""
    return bpe.bpe_digest(pick(docs, doc_id="doc_id", text="text"), RANKS, public_tokenizers.PATTERN)


STAGES = [
    ("quality", keep_good),
    ("line dedup", drop_lines),
    ("near duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("byte-level BPE", to_tokens),
]

# A fitted classifier, random signatures and merges are not stated in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = load(spark, sf_dir, "documents")
    for _, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir))
    return docs
