"""Sources: .tex files under a root, and any table of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.ordering import numbered


def tex_files(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, text) of all .tex files below root but those under node_modules or .git; unreadable files are skipped."""
    read = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.tex").option("ignoreCorruptFiles", True)
    df = read.text(root).select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("text"))
    return df.filter(~F.col("file_path").rlike("/(node_modules|\\.git)/"))


def in_order(files: DataFrame) -> DataFrame:
    """files with file_ord, by path in Unicode collation."""
    return numbered(files, [F.collate("file_path", "UNICODE"), F.col("file_path")], "file_ord")


def documents(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """A table of texts as files: the id is the order."""
    return df.select(F.concat(F.lit("doc-"), F.col(id_column).cast("string")).alias("file_path"), F.col(id_column).cast("long").alias("file_ord"), F.col(text).alias("text"))


def is_save_event(path: Column, scheme: Column, untitled: Column, enabled: Column, root: str) -> Column:
    """Whether a save starts an analysis: enabled, titled, a file below root that ends in .tex in any case."""
    return enabled & ~untitled & (scheme == "file") & F.lower(path).endswith(".tex") & path.startswith(root.rstrip("/") + "/")
