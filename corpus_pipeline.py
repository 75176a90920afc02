"""From raw documents to a training mix: language, exact copies, near copies, leaked test items, weights.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and
read again as the next stage's docs.  All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadentia.llm.common import without, written
from cadentia.llm.decontam import decontaminate
from cadentia.llm.exact import drop_copies
from cadentia.llm.langid import identify
from cadentia.llm.minhash import near_dedup
from cadentia.llm.mixing import mix_sources

#: Documents whose language is less certain than this, or that have no letter, go.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language.  Null and empty texts and those without a letter go; repeated rows are judged each;
    rows with a null lang or doc_id are judged, but teach nothing if they have no lang.  Extra columns stay."""
    return identify(docs).filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each text (null: empty): of the largest doc_id; of rows that repeat it, the least by all columns."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: of the least doc_id.  Rows with a null or repeated doc_id are rows of their own
    (any of them may be the one that stays); texts without a word are linked with nothing and stay."""
    return without(docs, lambda rows: near_dedup(rows).filter("NOT kept"), "pipeline-near")


def leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no test item, whatever their doc_id; with an empty benchmark, all."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy in the mix: the columns of docs and copy, from 1 (in place of a column of that name).  Each row of docs has
    its share by its own size, also with a null or repeated doc_id; a null source is one of its own."""
    drawn = mix_sources(docs.drop("copy"), whole=True).filter("copies > 0")
    return drawn.select("document.*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))


STAGES = [("language", language), ("exact dedup", exact), ("near dedup", near), ("decontamination", leaked), ("mixing", mix)]

#: Language identification and alignment have no SQL form; tests/llm compares run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{k}")
    return docs
