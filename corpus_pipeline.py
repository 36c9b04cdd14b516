"""Corpus pipeline: toxicity, near duplicates, benchmark passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents. Stages decide row by row: where one needs to tell rows apart it numbers them, so null ids, repeated ids
and repeated rows are judged each for itself. Helper columns get names that no column of the documents has. An empty
table gives an empty one; null and empty texts are not toxic evidence, are one group of near duplicates, hold no passage
and no secret, and pack as their end id.

The similar-text stage links texts whose runs of five words have a Jaccard similarity of 0.8 or more: candidates of op3's
SimHash multi-index (4 bits) and, as such texts can differ in more bits, of MinHash bands, checked on whole shingle sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from starprism.llm import decontamination, minhash, packing, secrets, toxicity
from starprism.llm.common import materialize, table, with_row_id


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go. It learns from the labels of documents that came in; without any
    labelled row nothing goes."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, that with the smallest id stays (one row, if it is repeated; of a group without
    any id, one)."""
    keyed, own = with_row_id(docs, "numbered")
    return keyed.join(minhash.kept_rows(keyed, own).withColumnRenamed("rid", own), own, "left_semi").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage (a window) of any benchmark item go; op4's column asks for two items."""
    keyed, own = with_row_id(docs, "numbered")
    found = decontamination.contaminated_rows(keyed, own, table(spark, sf_dir, "benchmark")).withColumnRenamed("rid", own)
    return keyed.join(found, own, "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; the secrets found in it are masked."""
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document, with its sequence and place."""
    return packing.op1(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("secrets", mask_secrets), ("packing", pack_sequences)]

#: Networks, fingerprints and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each one's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
