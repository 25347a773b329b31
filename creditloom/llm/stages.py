"""Stages of the corpus pipeline: each applies one operator to all rows it is given."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.sources.tables import table

from . import langid, pii
from .common import if_small, written
from .decontaminate import clean
from .jaccard import BROADCAST_ROWS, JaccardJoin
from .packing import pack_documents
from .queries import word_tokenizer

#: Mean window probability below which a text's language counts as not recognised.
LEAST_SCORE = 0.3


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a letter and a recognised language.

    The network learns from the rows that have a lang.  Without any, nothing is learned and nothing rejected but texts
    without a letter.  NULL texts go.
    """
    net = langid.fit(docs)
    if net is None:
        return docs.where(langid.lettered(F.col("text")))
    found = docs.withColumn("_language", langid.identify(net, F.col("text")))
    kept = (F.col("_language.label") != langid.UNKNOWN) & (F.col("_language.score") >= LEAST_SCORE)
    return found.where(kept).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity 0.8 or more, links followed).

    The row with the smallest doc_id stays; of repeated rows one.  Rows without words have no links and stay.
    """
    rows = numbered(docs)
    classes = JaccardJoin(rows.select(F.col("_row").alias("doc_id"), "text"), width=5, num=80, den=100).result()
    classes = classes.select(F.col("doc_id").alias("_row"), "component_id")
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_row").alias("row"))
    shared = classes.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1")
    members = written(classes.join(written(shared, "shared"), "component_id").select("_row", "component_id"), "members")
    n = members.count()
    ids = rows.select("_row", "doc_id").join(if_small(members, n, BROADCAST_ROWS), "_row")
    ids = written(ids.select("_row", "component_id", key.alias("key")), "keys")
    first = written(ids.groupBy("component_id").agg(F.min("key").alias("first")), "first")
    gone = ids.join(first, "component_id").where("key.row <> first.row").select("_row")
    return rows.join(if_small(written(gone, "gone"), n, BROADCAST_ROWS), "_row", "left_anti").select(*docs.columns)


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number ``_row`` that stays the same whenever the rows are read.

    Rows of files are known by their file and place in it; rows of any other frame are written first.
    """
    try:
        placed = docs.withColumns({"_file": F.col("_metadata.file_path"), "_place": F.col("_metadata.row_index")})
    except AnalysisException:
        return written(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    spark = docs.sparkSession
    files = sorted(r[0] for r in placed.select("_file").distinct().collect())  # one name for each file
    names = spark.createDataFrame(list(enumerate(files)), "_number long, _file string")
    row = F.shiftleft("_number", 40) + F.col("_place")
    return placed.join(F.broadcast(names), "_file").withColumn("_row", row).drop("_file", "_place", "_number")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every span of personal data replaced by its kind."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in training sequences."""
    return pack_documents(docs, word_tokenizer())
