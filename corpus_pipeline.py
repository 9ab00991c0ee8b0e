"""A corpus pipeline of five stages: toxicity, near-duplicates, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir), reads what its predecessor kept and returns a DataFrame; run() writes each result as
Parquet in the shared folder and reads it again as the next one's docs. All but the last return the columns of documents.

Every stage takes empty tables (no rows come out), null ids and texts, repeated rows and further columns of any name:
* toxicity, decontamination and pii decide and change each row by its text alone; a null or empty text is kept as it is.
* near-duplicates keep rows without id or words; of equal rows with one id one stays.
* packing gives every row its pieces; a null text is that of one end token. Further columns are not read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorwise.llm import decontamination, near_dedup, packing, pii, toxicity
from priorwise.llm.common import discard, free_name, saved, table
from priorwise.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones outside the held-out fold, doesn't find toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't cover a benchmark item."""
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def hide_people(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data; n_chars is that of the new text."""
    count = free_name(docs, "_entities")
    out = pii.replace_pii(docs, count=count)
    changed = F.col(count) > 0
    return out.select(*[F.when(changed, F.length("text").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return packing.pack_documents(docs, vocabulary(), keep_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic), ("near_dedup", drop_copies), ("decontamination", drop_leaks), ("pii", hide_people), ("packing", pack),
]

#: A trained classifier and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = saved(stage(spark, docs, sf_dir))
        if i:
            discard(docs)
        docs = out
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
