"""Corpus pipeline: each stage works on all that the one before kept; all but the last keep the columns of documents.

In every stage a null text stays null and an empty one empty, texts have no greatest length, columns that
documents doesn't have pass through whatever their names, and an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadweave.llm import jaccard, linededup, packing, pii, toxicity
from leadweave.llm.queries import surrogate_key, vocabulary
from leadweave.llm.tables import fresh, read, written

#: Ids that stand for missing ones begin here; they come after all others.
_NO_ID = 1 << 62


def _counted(docs: DataFrame, kind: str) -> DataFrame:
    """docs with n_chars, of this type, of the texts as they are now."""
    n: Column = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text"))
    return docs.withColumn("n_chars", n.cast(kind))


def _listed(ids: DataFrame) -> tuple[DataFrame, int]:
    """The ids and their number; up to BROADCAST_ROWS of them go to the texts, beyond it the texts are shuffled to the ids."""
    ids = written(ids, "ids")
    n = ids.count()
    return F.broadcast(ids) if n <= jaccard.BROADCAST_ROWS else ids, n


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that the severity model rejects; repeated rows go or stay together."""
    model = toxicity.train(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a large share of their source repeats; the source stands for the host.

    A line at the share itself stays; repeated rows are pages of their own; a null source is one source.
    """
    return _counted(linededup.drop_site_lines(docs, F.col("source")), docs.schema["n_chars"].dataType.simpleString())


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id.

    Rows of one id and equal text are one. A row without an id is in the group of its text and stays only
    if no row with an id is in it; one of equal such rows stays. Texts without words are in no group.
    """
    own = fresh(docs, "own")
    text_id = F.lit(_NO_ID) + F.pmod(F.xxhash64("text"), F.lit(_NO_ID))
    known = docs.withColumn(own, F.coalesce(F.col("doc_id").cast("bigint"), F.when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), text_id)))
    found = written(jaccard.shingle_components(known, id_col=own), "components")
    extra, _ = _listed(found.where(F.col("component_id") != F.col(own)).select(own).distinct())
    often, repeats = _listed(found.where(F.col(own).isNotNull()).groupBy(own).count().where("count > 1").select(own))
    kept = known.join(extra, own, "left_anti")
    if repeats:
        # Only rows of ids that repeat are compared.
        one = kept.join(often, own, "left_semi").dropDuplicates([own, "text"])
        kept = kept.join(often, own, "left_anti").unionByName(one)
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data; repeated rows get the same text."""
    return _counted(pii.pseudonymise(docs, surrogate_key(spark), count_col=None), docs.schema["n_chars"].dataType.simpleString())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens; repeated rows are packed each."""
    return packing.best_fit(docs, vocabulary("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic), ("line dedup", drop_site_lines), ("n-gram Jaccard join", drop_near_duplicates), ("PII", replace_personal_data), ("best-fit packing", pack),
]

#: No SQL: the first stage is a trained classifier.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
