"""Inputs that several queries share, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a small table, as it is stored.
SMALL = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of less than :data:`SMALL` bytes often is one row group, which one task would read and work on alone, so
    its rows are dealt to all cores. Larger tables are read as they lie."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(spark.sparkContext.defaultParallelism) if size <= SMALL else df


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of their sources, with running lines, page numbers, captions, references and broken words."""
    from pyspark.sql import Window

    d = table(spark, sf_dir, "documents")
    number = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("int")
    text = F.concat(
        F.lit("Volume "), "source", F.lit("\n"), F.replace(F.col("text"), F.lit("the "), F.lit("th-\ne ")), F.lit("\n  "), (F.col("doc_id") % 500).cast("string"), F.lit("  \nPage "), F.col("doc_id").cast("string"),
        F.lit("\nTable 3. Values\nChapter 2 Notes\nSeen [1, 2]  here [3].\n"), F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("Chapter "), (F.col("doc_id") % 9).cast("string"), F.lit(": Part\n"))).otherwise(""), F.lit("End of volume"),
    )
    return d.select("doc_id", F.col("source").alias("source_file"), number.alias("page_number"), text.alias("text"))


PAGES = r"""pages0 AS (
  SELECT doc_id, source AS source_file, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INT) AS page_number,
         'Volume ' || source || chr(10) || replace(text, 'the ', 'th-' || chr(10) || 'e ') || chr(10) || '  ' || (doc_id % 500) || '  ' || chr(10) || 'Page ' || doc_id || chr(10)
         || 'Table 3. Values' || chr(10) || 'Chapter 2 Notes' || chr(10) || 'Seen [1, 2]  here [3].' || chr(10)
         || CASE WHEN doc_id % 7 = 0 THEN 'Chapter ' || (doc_id % 9) || ': Part' || chr(10) ELSE '' END || 'End of volume' AS text
  FROM documents
)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns (aid, candidate) and the user turn before each (reference)."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    return c.withColumn("before", F.lag("text").over(w)).withColumn("who", F.lag("role").over(w)).where("role = 'assistant' AND who = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("aid"), F.col("text").alias("candidate"), F.col("before").alias("reference"))


TURNS = """turns AS (
  SELECT conv_id * 1000 + turn AS aid, text AS candidate, before AS reference FROM (
    SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS who FROM conversations
  ) WHERE role = 'assistant' AND who = 'user'
)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired samples by language, drawn from the documents' lengths: lang, id, base, other."""
    d = table(spark, sf_dir, "documents")
    return d.select("lang", F.col("doc_id").alias("id"), (F.col("n_chars") % 97 / 97.0).alias("base"), ((F.col("n_chars") * 7 + F.col("doc_id")) % 89 / 89.0).alias("other"))


SAMPLES = "samples AS (SELECT lang, doc_id AS id, (n_chars % 97) / 97.0::DOUBLE AS base, ((n_chars * 7 + doc_id) % 89) / 89.0::DOUBLE AS other FROM documents)"
