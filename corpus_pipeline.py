"""The corpus pipeline: five stages over ``documents``, each written as Parquet and reread by the next.

Stages in order: quality classifier, line deduplication, SimHash near-duplicates (one document of each
group stays), benchmark decontamination, byte-level BPE. All but the last return the columns of
``documents``; the last returns one row a document with its token count and digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import bpe, decontaminate, lines, quality, similar
from tracelake.llm.common import discard, mark, stored, sweep, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling keeps."""
    return quality.resample(docs.select(*COLUMNS), table(spark, sf_dir, "labels")).select(*COLUMNS)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that other documents repeat; n_chars counts what is left. Every document stays."""
    done = lines.dedup_lines(docs.select(*COLUMNS))
    changed = F.col("n_dropped") > 0
    return done.select("doc_id", F.when(changed, F.col("kept")).otherwise(F.col("text")).alias("text"), "lang", "source", F.when(changed, F.length("kept").cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each near-duplicate group, texts without words being one group.

    Near duplicates share at least 0.8 of their five-word shingles (Jaccard), directly or over others.

    Rows that repeat an id count once (the least by text, lang, source, n_chars); rows without an id stay.
    """
    docs = docs.select(*COLUMNS)
    known = docs.where("doc_id IS NOT NULL")
    gone = stored(similar.groups(known).where("component_id < doc_id").select(F.col("doc_id").alias("gone")).distinct(), "gone", count := docs.count())
    kept = docs.join(gone, F.col("doc_id") == F.col("gone"), "left_anti")
    repeated = stored(known.groupBy(F.col("doc_id").alias("again")).count().where("count > 1").select("again"), "repeated", count)
    if not repeated.limit(1).count():
        return kept
    same = F.col("doc_id") == F.col("again")
    one = kept.join(repeated, same, "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("r")).select("doc_id", "r.*")
    return kept.join(repeated, same, "left_anti").unionByName(one).select(*COLUMNS)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_chars, n_tokens, ids_sha256, decoded_sha256) of every document."""
    import public_tokenizers

    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=("doc_id", "lang", "source", "n_chars"))


#: What the stage before this one has stored, apart from its result.
_BEFORE: list[str] = []


def _stage(function):
    """A stage, which first deletes what the one before has stored for itself: its result is written by now."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        sweep(spark, [p for p in mark() if p not in _BEFORE], [])
        before = mark()
        out = function(spark, docs, sf_dir)
        _BEFORE[:] = [p for p in mark() if p not in before]
        return out

    return run_stage


STAGES = [
    ("quality classifier", _stage(quality_stage)),
    ("line dedup", _stage(lines_stage)),
    ("SimHash near-dedup", _stage(near_duplicates_stage)),
    ("benchmark decontamination", _stage(decontaminate_stage)),
    ("byte-level BPE", _stage(tokens_stage)),
]

#: SQL can express neither the classifier nor the transducer; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        read, docs = docs, stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            before, docs = read, stored(docs, f"stage{number}")
            discard(before)
    return docs
