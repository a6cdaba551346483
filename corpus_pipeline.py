"""The corpus pipeline: quality, near-duplicates, benchmark leaks, secrets, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhawk.llm import decontaminate, near_dup, packing, quality, secrets
from tallyhawk.plans.session import cut, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (score of 0.3 and more).

    Null and empty texts have the bias's score; a null id is judged by its text; repeated rows share their score
    and stay or go together; very long texts are scored whole; an empty table gives an empty table.
    """
    return quality.classify(docs, table(spark, sf_dir, "labels"), keep=tuple(COLUMNS)).where("predicted = 1").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class of near-duplicates; rows with equal id and text once.

    Null and empty texts and rows with a null id are classes by themselves and stay (equal ones once); of rows with
    equal id and text the one with the least (lang, source, n_chars) stays, nulls first; very long texts are
    compared like others; other columns, whatever their names, are left out; an empty table gives an empty table.
    """
    others = near_dup.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    kept = docs.select(*COLUMNS).join(others, "doc_id", "left_anti")
    one = kept.groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("_row"))
    return one.select("doc_id", "text", "_row.lang", "_row.source", "_row.n_chars").select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs.

    Null and empty texts have no words and stay; rows are judged by id and text (their SHA-256, so a clean row
    never goes with another one), so repeated rows and rows with a null id stay or go by their own text; very
    long texts are searched whole; with an empty benchmark all stay; other columns, whatever their names, are left out;
    an empty table gives an empty table.
    """
    keyed = docs.select(*COLUMNS, F.unhex(F.sha2(F.to_json(F.struct("doc_id", "text")), 256)).alias("_key"))
    leaks = decontaminate.find_leaks(keyed, table(spark, sf_dir, "benchmark"), keep=("_key",))
    return keyed.join(leaks.where("contaminated").select("_key").distinct(), "_key", "left_anti").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by ``[SECRET:kind]`` and ``n_chars`` counted anew.

    Null texts stay null, empty ones empty; ids are not looked at; repeated rows stay repeated; very long texts
    are scanned whole; an empty table gives an empty table.
    """
    return secrets.scan(docs.select(*COLUMNS), redact=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents.

    A null or empty text is its end id; a null id stays null; repeated rows are each packed; very long texts are
    cut at multiples of the sequence length; an empty table gives an empty table.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("leaks", drop_leaks),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: SQL cannot express the learnt stages; the tests hold them against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
