"""Corpus pipeline: quality filter, line dedup, near-dedup, decontamination, BPE.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame. All but the last return the columns of ``documents``;
``n_chars`` follows the text where a stage changes it. ``run`` writes each
stage's result as Parquet to the shared checkpoint folder and reads it again.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwise.llm.bpe import encode_decode, with_digests
from barwise.llm.common import table
from barwise.llm.decontaminate import decontaminate
from barwise.llm.lines import drop_frequent_lines
from barwise.llm.quality import quality_scores
from barwise.llm.simhash import fingerprint, rooted_fingerprints
from barwise.session import ensure_checkpoint_dir


def _on_documents(stage):
    """A stage over doc_id and text; the other columns pass it under names that
    clash with none of its own. ``n_chars`` is counted anew."""
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = {c: f"__own{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
        out = stage(spark, docs.withColumnsRenamed(own), sf_dir).select("doc_id", "text", *own.values())
        out = out.withColumnsRenamed({v: k for k, v in own.items()})
        if "n_chars" in docs.columns:
            out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
        return out.select(*docs.columns)

    return run_stage


@_on_documents
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    """Documents that the classifier gives ``threshold`` or more; null and empty
    texts are scored like others."""
    return quality_scores(docs, table(spark, sf_dir, "labels")).filter(F.col("score") >= threshold)


@_on_documents
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; a null text becomes empty, an empty
    one stays so. Repeated rows each lose their lines; other columns pass, whatever
    their names."""
    return drop_frequent_lines(docs)


@_on_documents
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component one row stays: the smallest id (no id sorts
    last), then the smallest fingerprint, then the smallest hash of the text."""
    fps, rooted = rooted_fingerprints(docs, words_per_shingle=4, max_bits=4)
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("least").isNull(), "least", "fp")).alias("s")).select(
        F.col("s.least").alias("__id"), F.col("s.fp").alias("__fp"))
    rows = fps.filter("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.count("fp").alias("__n"))
    alone = first.join(rows.filter("__n = 1"), "__id").select(F.col("__id").alias("doc_id"))
    once = docs.join(alone, "doc_id", "left_semi")
    # only the rows of repeated ids and those without one are told apart by fingerprint
    several = docs.join(rows.filter("__n > 1").select(F.col("__id").alias("doc_id")), "doc_id", "left_semi")
    again = several.unionByName(docs.filter("doc_id is null")).withColumn("__own_fp", fingerprint("text", 4))
    again = again.join(first, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own_fp") == F.col("__fp")), "left_semi")
    least = F.min_by(F.struct(*docs.columns), F.struct(F.xxhash64("text"), "text"))
    return once.unionByName(again.groupBy("doc_id", "__own_fp").agg(least.alias("__row")).select("__row.*"))


@_on_documents
def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts; documents stay. A null text stays
    null, an empty one empty; repeated rows are cut alike; other columns pass,
    whatever their names."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_sha256, decoded_sha256), one row per row; a null or
    empty text has no ids; other columns are not read."""
    return with_digests(encode_decode(docs.select("doc_id", "text")), "ids")


STAGES = [
    ("quality", keep_good),
    ("lines", drop_lines),
    ("near_copies", drop_near_copies),
    ("benchmark", cut_benchmark),
    ("bpe", tokenize),
]

#: SQL can't express the classifier, the fingerprints or BPE
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4()}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
