"""Corpus pipeline: quality, language, near duplicates, decontamination and
packing, each over all rows that the stage before it kept.

Every stage takes rows as they come: repeated rows and ids are judged each by
its own text, ties do not arise but where a stage says so, columns beyond those
of documents are dropped, texts of any length are read whole, and an empty
table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chapterlake.llm import common, decontaminate, jaccard, langid, packing, quality, queries

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Scores under these are rejected.
QUALITY_MIN, LANGUAGE_MIN = 0.5, 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose quality score is QUALITY_MIN or more (a score of
    just that stays). Null and empty texts are scored by their statistics, a null
    n_chars counts as absent; without labelled rows the score is one constant."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~common.held_out(F.col("doc_id")))
    model = quality.fit(docs.filter(~common.held_out(F.col("doc_id"))), labels, "quality", queries.METADATA)
    return quality.score(docs.select(*COLUMNS), model, queries.METADATA).filter(F.col("score") >= QUALITY_MIN).select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of a learned language; `und` and scores under
    LANGUAGE_MIN go, so null texts and those without a letter do. Rows of null
    lang are not learned from, but judged; where no row has a lang, all go."""
    model = langid.fit(docs.filter(~common.held_out(F.col("doc_id"))))
    kept = langid.predict(docs.select(*COLUMNS), model).filter((F.col("lang_pred") != "und") & (F.col("score") >= LANGUAGE_MIN))
    return kept.select(*COLUMNS)


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates (five-word shingles,
    similarity 0.8 or more): that of smallest doc_id, null ids after all others,
    any one of those that share the id. Rows are told apart by a written key,
    so rows of a null or repeated id count each for itself. Null and empty
    texts have no duplicates."""
    keyed = common.stage(docs.select(*COLUMNS).withColumn("row_key", F.monotonically_increasing_id()), "keyed")
    found = jaccard.similar_components(keyed.select(F.col("row_key").alias("doc_id"), "text"), 5, 80)
    found = found.select(F.col("doc_id").alias("row_key"), "component_id").join(keyed.select("row_key", "doc_id"), "row_key")
    found = common.stage(found, "components_of_rows")
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row_key")
    first = found.groupBy("component_id").agg(F.min(order)["row_key"].alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = common.stage(first, "firsts")
    # a group may hold a third of all rows: its rows are dealt to several tasks
    hot = common.hot_keys(first, ["component_id"], "n", found.count())
    gone = common.join_hot(found, first.drop("n"), ["component_id"], hot, "row_key").filter("row_key <> first").select("row_key")
    return keyed.join(gone, "row_key", "left_anti").select(*COLUMNS)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes rows that hold a passage of the benchmark. Null and empty texts
    hold none; a null or empty benchmark item removes nothing."""
    return decontaminate.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the kept documents into sequences of 2048 tokens: one row a piece,
    with the row's own doc_id (null where it is). A null or empty text is its
    end id alone."""
    return packing.pack_documents(docs, queries.tokenizer_path(), 2048)


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("n-gram Jaccard join", duplicate_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("best-fit packing", packing_stage),
]

#: The classifiers, tokenizer and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each stage's rows are written as Parquet in
    the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.stage(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
