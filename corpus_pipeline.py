"""A corpus pipeline of five stages, each an operator of glossarium.llm applied to all that the stage before kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All stages but the last
return the columns of documents. ``run`` writes each stage's rows as Parquet in the folder that driver and executors
share and reads them again for the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossarium.llm import lines, minhash, mixing, pieces, toxicity
from glossarium.llm.common import crc_fold, shared_dir, table

#: Shares of the mixture's tokens after the toxic documents have gone: about what a clean corpus has.
TARGETS = {"clean": 0.87, "low_quality": 0.13, "toxic": 0.0}

_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that toxicity does not reject, as they are. Null and empty texts are scored like any other; of rows with
    one id all go if one does; rows without an id stay; an empty table gives none; further columns go."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(crc_fold("doc_id", 4) != 2))
    bad = toxicity.score(docs, model).where(F.col("score") >= toxicity.THRESHOLD).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*_COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that line dedup removes. Documents that lose every line go; those that were empty or null
    stay, as empty ones; equal rows stay as many, all of them with what one of them keeps; rows without doc_id count as one
    document; an empty table gives none; further columns go."""
    left = lines.dedup_lines(docs, more=("lang", "source")).where((F.col("n_removed") == 0) | (F.length("text") > 0))
    return left.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each class of near duplicates; documents without words are classes of their own. Rows of
    one id stay or go together; rows without an id stay; an empty table gives none; further columns go."""
    gone = minhash.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*_COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each row as mixing gives it, none for some. Rows of one id and text get the same number each; null
    and empty texts have no tokens and are judged by their measures; an empty table gives none; further columns go."""
    keyed = docs.select(*_COLUMNS).withColumn("text_key", F.xxhash64("text"))
    copies = mixing.mix(keyed, table(spark, sf_dir, "labels"), TARGETS, more=("text_key",)).select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "copies")
    copies = copies.where("copies > 0").distinct()
    out = keyed.join(copies, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*_COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids, the decoded text and the spans of each row."""
    return pieces.digests(pieces.encode_documents(docs, pieces.public_model()))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: The stages learn, hash and iterate in ways that SQL cannot say; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    top = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path = f"{top}/{k}_{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
