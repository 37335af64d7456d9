"""Labelled samples of bounded size for the classifiers that are fitted here."""

from __future__ import annotations

import pickle

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm import textbytes as tb
from cadenza.llm.workspace import Workspace, ship

#: A fitted model is sent from its task in pieces of this size.
PART_BYTES = 1 << 20


def held_out(doc_id: str, folds: int, fold: int):
    """True for rows whose crc32(id as text) mod folds is ``fold``: labels of these are never learnt from. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, rows: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, y, text): at most ``rows`` labelled texts of each class outside the held-out fold, chosen by a hash of the id.

    Ids with contradicting labels and null labels or texts are left out; of rows that repeat an id the least text is taken.
    """
    known = labels.where(~held_out(doc_id, folds, fold) & F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
    one = known.groupBy(F.col(doc_id).alias("doc_id")).agg(F.min(label).alias("y"), F.max(label).alias("z")).where("y = z").select("doc_id", "y")
    picked = None
    for y in (0, 1):
        own = one.where(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit(y)), "doc_id").limit(rows)
        picked = own if picked is None else picked.unionByName(own)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    return texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.first("y").cast("int").alias("y"), F.min("text").alias("text"))


def fitted(chosen: DataFrame, fit, ws: Workspace):
    """What ``fit(texts, labels)`` makes of the bounded sample, in one task of an executor; only the model reaches the driver.

    The sample is written first, so a lost executor repeats the fit alone. Texts come in the order of their ids, so that
    every run fits the same model.
    """

    def run(batches):
        rows = sorted((i, y, t) for batch in batches for i, y, t in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        texts, marks = [t for _, _, t in rows], [y for _, y, _ in rows]
        rows.clear()
        raw = pickle.dumps(fit(texts, marks), protocol=5)
        parts = [raw[k : k + PART_BYTES] for k in range(0, len(raw), PART_BYTES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["k", "part"])

    kept = ws.table("sample", chosen.select("doc_id", "y", "text"))
    got = kept.repartition(1).mapInArrow(tb.tidied(run), "k int, part binary").collect()  # the size of the model, which is fixed
    return pickle.loads(b"".join(bytes(r.part) for r in sorted(got, key=lambda r: r.k)))


def with_scores(docs: DataFrame, scorer, doc_id: str, text: str, folds: int, fold: int) -> DataFrame:
    """Columns of ``docs`` with held_out, score and predicted, ``scorer`` mapping an Arrow string column to scores.

    Result columns replace columns of ``docs`` of the same names.
    """
    ship(docs.sparkSession)
    base = docs.drop("score", "predicted", "held_out")
    where = base.schema.fieldNames().index(text)

    def run(batches):
        for batch in batches:
            score = scorer(batch.column(where).cast(pa.large_string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns)), pa.array(score, pa.float64())], [*batch.schema.names, "score"])

    scored = base.mapInArrow(tb.tidied(run), T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType())]))
    return scored.select(*base.columns, held_out(doc_id, folds, fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
