"""A corpus pipeline of five stages over ``documents``.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``. All but the last
return the columns of ``docs``; the last returns packed token pieces.

1. ``toxicity``: documents with a toxicity score of 0.5 or more go.
2. ``quality``: documents with a quality score below 0.3 go.
3. ``near_duplicates``: of each group of near-duplicate texts the one of the smallest
   id stays (repeated rows of it: one of them). Other texts of that id are judged as
   texts: they stay unless they are near-duplicates of another text that does.
4. ``substring_dedup``: words of 50-word windows that repeat from a smaller id
   are cut from the texts; ``n_chars`` follows the text. Documents stay, however
   little is left of them.
5. ``packing``: the texts as token pieces, packed into sequences of 2048.

Documents with a null id pass the first two stages like others; the third keeps
one of each text (and none where the text has a row with an id).

Every stage takes null, empty and very long texts, repeated rows and ids, empty tables and
further columns; what each makes of them is stated with its operator and its function here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trafficbrick.llm import jaccard_join, packing, quality, substring_dedup, toxicity
from trafficbrick.llm.token_counts import tokenizer_path
from trafficbrick.session import read_table, scratch_path, ship_package


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text scores below 0.5; null and empty texts have the score of no evidence and stay."""
    ship_package(spark)
    scored = toxicity.score_toxicity(docs, toxicity.train(spark, docs, sf_dir))
    return scored.where(F.col("predicted") == 0).select("rest.*")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text scores 0.3 or more; null and empty texts have the score of all statistics 0."""
    ship_package(spark)
    scored = quality.score_quality(docs, quality.train(spark, docs, sf_dir))
    return scored.where(F.col("predicted") == 1).select("rest.*")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group of texts: that of the smallest id (none is the largest), of the texts
    that share it the one of the smallest digest. Rows are judged by their texts, so other texts of an id stay.
    """
    ship_package(spark)
    found = jaccard_join.near_duplicates(docs)
    least = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("digest").alias("digest"))
    kept = found.groupBy("group").agg(F.min(least).alias("k")).select(F.col("k.id").alias("__id"), F.col("k.digest").alias("__digest"))
    keyed = docs.withColumn("__digest", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    here = keyed.alias("d").join(kept.alias("k"), F.col("d.doc_id").eqNullSafe(F.col("k.__id")) & (F.col("d.__digest") == F.col("k.__digest")),
                                 "left_semi")
    # rows that repeat both: one of them stays
    same = Window.partitionBy("doc_id", "__digest").orderBy(*[F.col(c) for c in docs.columns if c not in ("doc_id", "text")])
    return here.withColumn("__n", F.row_number().over(same)).where(F.col("__n") == 1).select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their texts (null: empty) without the words that repeat from a smaller id, joined by one blank;
    ``n_chars``, where there is such a column, counts the new text's characters."""
    ship_package(spark)
    out = substring_dedup.remove_repeats(docs)
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast(docs.schema["n_chars"].dataType)} \
        if "n_chars" in docs.columns else {"text": F.col("text")}
    return out.select(*[new[c].alias(c) if c in new else F.col("rest")[c].alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts (null: empty) as token pieces with their place in sequences of 2048; one piece at least for each row."""
    ship_package(spark)
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_duplicates", keep_one_of_each),
    ("substring_dedup", cut_repeats),
    ("packing", pack),
]

#: SQL can express no stage but the cut of repeats; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written under the checkpoint folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        where = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(where)
        docs = spark.read.parquet(where)
    return STAGES[-1][1](spark, docs, sf_dir)
