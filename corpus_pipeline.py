"""Corpus pipeline: documents in, token shards out.

``STAGES`` lists the stages in order; each takes ``(spark, docs, sf_dir)`` and
returns a DataFrame, which ``run`` writes as Parquet in the shared checkpoint
folder and reads again for the next stage. All but the last return the
columns of ``documents``. No stage leaves out rows that its operator keeps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from docweave.llm import decontaminate, mixing, quality, simhash, token_ids
from docweave.llm.common import discard, stage
from docweave.llm.queries import BYTE_BPE, tokenizer
from docweave.session import ensure_checkpoint_dir

#: SQL cannot express the classifier, SimHash, the draw or the token ids; the
#: stages are tested against brute force.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance-resampling classifier keeps. Null and
    empty texts have weight zero; rows that repeat an id and a text share
    their fate; ties at the cut stay; a null id is a key like any other; no
    documents give none; without labels every document stays."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the smallest id, of equal
    ids the least text key, one of rows that agree in both. Null and empty
    texts are one class; a class without ids keeps one row; no documents give none."""
    return simhash.drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item. Null and empty texts contain
    none; items without words are in nothing; rows that repeat an id and a
    text share their fate; no documents give none."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it. Null and empty texts
    have no words and are drawn last; a null source is a source of its own;
    rows that repeat an id and a text share their fate; ties in rank go by id
    and text key; no documents give none."""
    return mixing.draw(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards, written and read back: ``doc_id, start, n_tokens,
    ids_crc32``. A null text is empty: its end id alone; repeated rows, as the
    mix makes them, are written each; a null id comes first; no documents give
    none."""
    out = f"{ensure_checkpoint_dir(spark)}/pipeline-tokens-{uuid.uuid4().hex}"
    token_ids.write_token_ids(docs, out, tokenizer(BYTE_BPE))
    return token_ids.read_index(spark, out)


STAGES = [("quality classifier", quality_classifier), ("SimHash near-dedup", simhash_near_dedup),
          ("benchmark decontamination", benchmark_decontamination), ("source mixing", source_mixing),
          ("token output", token_output)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``STAGES`` one after the other; a stage's table goes when the next one is written."""
    docs, old = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
        if old is not None:
            discard(old)
        old = docs
    out = STAGES[-1][1](spark, docs, sf_dir)
    if old is not None:
        discard(old)
    return out
