"""File sources and format helpers: whole-file text folders, the corpus
and chunk CSVs, vector literals, question bodies, layout results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def read_text_folder(spark: SparkSession, path: str, glob: str = "*.txt",
                     recursive: bool = False) -> DataFrame:
    """(fname, text): one row per whole file (UTF-8). The ``wholetext``
    keyword must be passed to ``text()``: as an option it is overridden
    and gives one row per line."""
    df = spark.read.text(path, wholetext=True, pathGlobFilter=glob,
                         recursiveFileLookup=recursive)
    return df.select(F.col("_metadata.file_path").alias("fname"), F.col("value").alias("text"))


def read_raw_pages(spark: SparkSession, path: str, glob: str = "*.html",
                   recursive: bool = True) -> DataFrame:
    """(path, html) of raw captured bodies stored as files (UTF-8)."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob) \
        .option("recursiveFileLookup", recursive).load(path)
    return df.select("path", F.decode(F.col("content"), "UTF-8").alias("html"))


def read_paged_documents(spark: SparkSession, path: str) -> DataFrame:
    """(sourcefile, page_num, text) from a parquet/JSON page table."""
    return spark.read.parquet(path).select("sourcefile", F.col("page_num").cast("int"), "text")


def write_corpus_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Corpus rows (fname, text) as CSV with a header; quotes, commas and
    newlines inside fields round-trip."""
    (df.select("fname", "text").write.mode(mode)
       .option("header", True).option("escape", '"').option("multiLine", True)
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
       .csv(path))


def read_corpus_csv(spark: SparkSession, path: str) -> DataFrame:
    """Corpus CSV read back with the columns renamed to (title, text)."""
    df = (spark.read.schema(schemas.CORPUS).option("header", True).option("escape", '"')
          .option("multiLine", True).option("ignoreLeadingWhiteSpace", False)
          .option("ignoreTrailingWhiteSpace", False).csv(path))
    return df.toDF("title", "text")


def vectors_to_text(df: DataFrame, col: str = "embedding", out: str = "embeddings") -> DataFrame:
    """Vector column as a printed list (``[0.1,0.2,...]``)."""
    return df.withColumn(out, F.to_json(F.col(col)))


def parse_vectors(df: DataFrame, col: str = "embeddings", out: str = "embedding") -> DataFrame:
    """Printed float lists parsed with ``from_json`` (never evaluated)."""
    return df.withColumn(out, F.from_json(F.col(col), "array<double>"))


def write_chunks(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Chunk table sink: parquet keeps ARRAY<FLOAT>; ``csv`` prints vectors."""
    if fmt == "csv":
        vectors_to_text(df).drop("embedding").write.mode(mode).option("header", True) \
            .option("escape", '"').csv(path)
    else:
        df.write.mode(mode).parquet(path)


def parse_question_bodies(df: DataFrame, col: str = "body") -> DataFrame:
    """Request bodies ``{"query": ...}`` -> question column."""
    return df.withColumn("question", F.from_json(F.col(col), schemas.QUESTION_BODY)["query"])


def read_question_lines(spark: SparkSession, path: str) -> DataFrame:
    """(question_id, question) from a text file, one question per line;
    blank lines are skipped (an empty line ends the interactive loop)."""
    df = spark.read.text(path).select(F.col("value").alias("question"))
    df = df.filter(F.length(F.trim("question")) > 0)
    return df.select(F.xxhash64("question").alias("question_id"), "question")


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """Layout-analysis results (one JSON object per document)."""
    return spark.read.schema(schemas.LAYOUT_RESULT).json(path)
