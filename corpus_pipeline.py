"""A corpus pipeline of five stages over the table documents.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last return the
columns of documents. ``run`` writes each stage's result to the shared folder and reads it back, and then
deletes what the stage has stored itself.

For every stage: a null text is an empty one; extra columns pass through, whatever their names; an empty
table gives an empty table; texts of any length are taken whole. What a stage does with null and repeated
ids and with ties stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtree.llm.common import BATCH_BYTES, stored, table, trimmed, unused
from fieldtree.llm.simhash_dedup import similar_removed
from fieldtree.llm.quality_classifier import fit, score
from fieldtree.llm.queries import TOKENIZER
from fieldtree.llm.sentencepiece_fst import encoded, read_model
from fieldtree.llm.source_mixing import mixed
from fieldtree.llm.suffix_dedup import cut_repeats
from fieldtree.storage import mark, release

#: Bytes of text of a shard in the suffix-array stage, whose arrays take some 40 times as much; a matter of memory alone.
SHARD_BYTES = 1 << 19


def rested(spark: SparkSession) -> None:
    """Executors give back memory that earlier stages have left with them, since a stage begins with all of it taken otherwise:
    workers what they have freed, and the heap what it has grown by. From then on Arrow batches are bounded in bytes too.

    One short task a core; the heap's part is Java's own call, by the SQL function ``reflect``.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).mapInArrow(trimmed, "id long").select(F.expr("reflect('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled ones, doesn't reject.

    Each row is judged by its text alone: empty texts get the trained bias, repeated rows one fate, null ids
    are judged like others. Without labels all scores are 0.5, and all rows stay.
    """
    rested(spark)
    model = fit(docs, table(spark, sf_dir, "labels"))
    out, mark = unused(docs, "score", "predicted")
    return score(docs, model, out=out, mark=mark).filter(F.col(mark) == 1).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard 0.8 or more on five-word shingles), that with the least id.

    Texts without words are one group. Of several texts with that least id the one with the least MD5 stays,
    of rows equal in both one. A row without an id goes if its group has an id; groups without any stay whole.
    """
    rested(spark)
    return similar_removed(docs, words=5)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes or more that occur more than once; every document stays.

    Ids play no part; a repeated row of 200 bytes or more loses all of its text; null texts stay null.
    """
    rested(spark)
    kept = cut_repeats(docs, shard_bytes=SHARD_BYTES)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled, and repeated up to ``COPIES`` times where their weight asks for it, so that the tokens kept have the target marginals.

    A null source or language is a value of its own. A hash of the id decides, so repeated ids share their
    fate, as do null ids; a row without tokens comes at most once.
    """
    rested(spark)
    return mixed(docs, repeats=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document; null ids stay null, repeated rows give repeated results."""
    rested(spark)
    return encoded(docs, read_model(TOKENIZER), words=1 << 16, group=1 << 18)


STAGES = [("quality classifier", quality), ("SimHash near-dedup", near_dedup), ("suffix-array dedup", passage_dedup), ("source mixing", mixing), ("SentencePiece encoding", encode)]

#: No SQL expresses the stages' hashes, training and transducers; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before = mark()
        docs = stored(stage(spark, docs, sf_dir), f"stage-{k}")
        release(spark, since=before, but=1)
    return docs
