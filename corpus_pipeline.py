"""A corpus pipeline: quality, near duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.columns import set_aside, unused
from cadenza.llm.decontaminate import RESULT, decontaminate
from cadenza.llm.jaccard import JaccardJoin
from cadenza.llm.mixing import copies_of
from cadenza.llm.quality import score_quality
from cadenza.llm.tokencount import count_tokens
from cadenza.llm.tokenfile import read_tokens, write_tokens
from cadenza.llm.workspace import Workspace


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field does not reject.

    Null and empty texts are one empty line and are judged as such, repeated rows alike, long texts whole. Columns of
    any names, those of scores included, come back as they were. Without labels nothing is rejected.
    """
    aside, back = set_aside(docs, ["score", "predicted", "held_out"])
    scored = score_quality(aside, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("predicted = 1").select(*back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked at a similarity of 0.8 over five-word shingles: the one with the smallest id.

    A row is told by its id and text, so different texts of one id, and texts without an id, are judged like others;
    an id comes before none, and of rows equal in both one stays. Documents without words are linked with nothing.
    Columns of any names come back as they were.
    """
    (row,) = unused(docs, "row")
    own = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64("text").alias("text"))
    marked = docs.withColumn(row, own)
    kept = JaccardJoin(marked, doc_id=row).labelled().where("doc_id = component_id").select(F.col("doc_id").alias(row)).distinct()
    return marked.join(kept, row, "left_semi").dropDuplicates([row]).select(*(f"`{c}`" for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item.

    Null and wordless texts hold none; repeated rows are judged alike, long texts whole. Columns of any names come back
    as they were.
    """
    aside, back = set_aside(docs, RESULT)
    return decontaminate(aside, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("n_hit = 0").select(*back)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources up to twice, as the flattest mixture within that limit takes them.

    Rows of one id and source are one unit; null ids and sources, empty texts and columns of any names are kept.
    """
    counted = count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=("source",))
    return copies_of(docs, repeats=2.0, counted=counted.withColumn("n_tokens", F.col("n_tokens") + 1))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files of the mixture, read back: doc_id, start, n_tokens, ids_crc32, part.

    Null texts are empty documents; repeated rows are written each; other columns are left out.
    """
    return read_tokens(write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_files", token_files),
]

#: SQL has no way to fit the classifier of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = ws.table(f"{k}-{name}", docs)
    return docs
