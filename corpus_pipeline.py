"""A corpus pipeline: toxicity, near duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and
returns a DataFrame, which ``run`` writes as Parquet to the shared folder and reads
again as the next stage's docs. All stages but the last return the columns of
``documents``, further ones included: rows go through the stages as one struct, so no name of a column
meets an operator's own.

Defined cases, in every stage: a null text is an empty one; a null doc_id, source or language is kept and stands for no other one;
very long texts are worked on whole; an empty table gives an empty table. What a stage does with empty texts, ties and
repeated rows is told at the stage.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm import mixing, neardup, packing, substring, toxicity
from granary.llm.common import unpacked, whole, written
from granary.llm.native import word_array

#: A repeated passage has so many words at least.
PASSAGE = 30


def rows_of(carrying: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand in ``carrying`` as the struct ``row``."""
    return carrying.select(*unpacked(F.col("row"), docs.columns))


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents over their language's toxicity threshold; learns from ``labels`` of rows that are not held out.

    An empty text is scored as a text without words; a score equal to the threshold is toxic; rows that stand twice are judged alike.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rows_of(toxicity.judged(docs, model).where(~F.col("toxic_verdict")), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest, of each component of 5-word shingle similarity 0.8 or more; rows without an id stay.

    Empty texts are near nothing and stay. Of rows with one id and the same words one stays, the smallest text; other texts of
    that id stay, as their copies under other ids go. Texts that tie there are equal.
    """
    own, text = docs.select(whole(docs).alias("row"), "doc_id"), F.col("row").getField("text")
    gone = written(neardup.near_duplicates(docs, words_each=5, percent=80).where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct(), "gone")
    left = own.join(gone, F.col("doc_id") == F.col("gone"), "left_anti")
    twice = written(own.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("twice")), "twice")
    if twice.isEmpty():
        return rows_of(left, docs)
    words = word_array(F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase))
    nth = F.row_number().over(Window.partitionBy("doc_id", F.array_join(words, " ")).orderBy(text))
    again = left.join(twice, F.col("doc_id") == F.col("twice"), "left_semi").withColumn("nth", nth).where("nth = 1").drop("nth")
    return rows_of(left.join(twice, F.col("doc_id") == F.col("twice"), "left_anti").unionByName(again), docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the passages of ``PASSAGE`` words or more that a smaller document holds; documents left without words go.

    A text that loses nothing, as an empty one, stays as it is; the words left of another one are joined by one space. Rows of one id
    take nothing from each other.
    """
    marked = substring.marked(docs, window=PASSAGE)
    changed = F.col("n_removed") > 0
    left = marked.where(~changed | (F.col("n_removed") < F.col("n_words")))
    new = {"text": F.col("kept_words"), "n_chars": F.length("kept_words").cast("long")}
    return left.select(*[F.when(changed, new[c]).otherwise(x).alias(c) if c in new else x for c, x in zip(docs.columns, unpacked(F.col("row"), docs.columns), strict=True)])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: a row for each time a document is taken, whole or in part, each file in the schedule's order.

    Empty texts are never taken; rows that stand twice, and texts of one id, are documents of their own.
    """
    return mixing.mixed_texts(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, with their ids, in sequences of at most 1024 tokens.

    An empty text is the end id alone; rows that stand twice are packed twice; ties go by the order of rows.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxic_documents),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("packing", packed),
]
#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
