"""The corpus pipeline: five stages over documents, each over all that the one before it kept.

Edge cases. Null and empty texts are scored like any other by the classifier; those it keeps have an empty text after line dedup and stay as long as no line
was taken from them. A document that line dedup leaves without any text goes. Rows without doc_id pass stages 1 to 4 (they can be named in no list of
documents that go) and are encoded. Of rows that repeat a doc_id stages 1 and 3 drop the id only if they would drop all of its rows; stage 2 takes the same line numbers from
all of them; stage 4 drops them all if one holds a benchmark item. Empty tables pass through. Columns beyond those of documents are left behind at the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import durable, table
from factloom.llm.decontamination import drop_contaminated
from factloom.llm.line_dedup import remove_repeated_lines
from factloom.llm.near_dedup import drop_near_duplicates
from factloom.llm.quality_classifier import quality_scores
from factloom.llm.queries import piece_model
from factloom.llm.sentence_pieces import encode_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Pre-tokens whose pieces a worker of the last stage remembers: its executor still holds what the stages before made it take.
REMEMBERED = 200_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    scores = quality_scores(docs, table(spark, sf_dir, "labels"))
    rejected = durable(scores.groupBy("doc_id").agg(F.max("predicted").alias("best")).where("best = 0").select("doc_id"), "rejected")
    return docs.join(rejected, "doc_id", "left_anti").select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand elsewhere; n_chars follows the text. A document without lines left goes."""
    left = remove_repeated_lines(docs.select(COLUMNS), min_chars=1)
    return left.withColumn("n_chars", F.length("text").cast("long")).where("n_removed = 0 or length(trim(text)) > 0").select(COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more)."""
    return drop_near_duplicates(docs).select(COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document."""
    return encode_documents(docs, piece_model(), REMEMBERED)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("near-duplicate documents", near_copies), ("benchmark decontamination", benchmark), ("sentence pieces", pieces)]

#: The stages learn weights and hash: SQL cannot express them; tests/llm hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = durable(docs, f"stage-{i + 1}")
    return docs
