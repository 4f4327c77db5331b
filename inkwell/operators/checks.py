"""The four deterministic checks over an element table, whole or for what changed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inkwell.functions import text as X
from inkwell.functions.ordering import following, prefix_sum
from inkwell.schema import LEVELS, RANGE, WARNING
from inkwell.sources.state import stage

SOURCE = "Thesis Logic"
RULES = ("punctuation", "abbreviation", "density", "caption")


def _diagnostics(found: DataFrame, rule: str, message: Column, code: str | None = None) -> DataFrame:
    key = F.col("element_key") if "element_key" in found.columns else F.lit(None).cast("string")
    return found.select(
        "file_path", "file_ord", "seq", *RANGE, message.alias("message"), F.lit(WARNING).alias("severity"), F.lit(SOURCE).alias("source"),
        F.lit(code).cast("string").alias("code"), F.lit(rule).alias("rule"), key.alias("element_key"),
    )


def sentences(elements: DataFrame) -> DataFrame:
    return elements.filter("type = 'sentence'")


def punctuation(elements: DataFrame) -> DataFrame:
    """Sentences that don't end like one."""
    found = sentences(elements).filter(~X.ends_sentence(F.col("content")) & (X.js_trim(F.col("content")) != ""))
    return _diagnostics(found, "punctuation", F.lit("句子缺少句末标点。"))


def first_uses(elements: DataFrame) -> DataFrame:
    """The sentence in which each unknown acronym is first used, and whether it defines it."""
    rows = sentences(elements).filter(F.col("content").rlike("[A-Z]{3}"))  # a quick look, most have none
    rows = rows.withColumn("acronym", F.explode(F.array_distinct(X.acronyms(F.col("content"))))).filter(~X.is_known(F.col("acronym")))
    keep = [c for c in rows.columns if c != "acronym"]
    first = rows.groupBy("acronym").agg(F.min_by(F.struct(*keep), F.struct("file_ord", "seq")).alias("r")).select("acronym", "r.*")
    return first.withColumn("defined", F.array_contains(X.defined_acronyms(F.col("content")), F.col("acronym")))


def abbreviations(elements: DataFrame, since: tuple[int, int] | None = None) -> DataFrame:
    """Acronyms whose first use, in document order over all files, has no definition. since: only first uses from that (file_ord, seq) on."""
    found = first_uses(elements).filter(~F.col("defined"))
    if since is not None:
        found = found.filter(F.struct("file_ord", "seq") >= F.struct(F.lit(since[0]).cast("long"), F.lit(since[1]).cast("long")))
    return _diagnostics(found, "abbreviation", F.concat(F.lit("缩写“"), F.col("acronym"), F.lit("”首次出现，应当给出全称。")), "ACRONYM_FIRST_USE")


def section_counts(elements: DataFrame, scope: str = "corpus") -> DataFrame:
    """Headings with their sentences up to the next heading and whether that one is deeper.

    One window per file, over places and levels only, counts the sentences of each heading and those before
    the first; all else is made of these counts. In corpus scope each file's last heading also gets the
    sentences that open the files after it, up to and with the next file that has a heading, through a table
    of a row per file.
    """
    level = F.coalesce(*[F.when(F.col("type") == t, n) for t, n in LEVELS.items()])
    rows = elements.filter(F.col("type").isin("sentence", *LEVELS)).select("file_ord", "seq", level.alias("level"))
    order = W.partitionBy("file_ord").orderBy("seq")
    rows = rows.withColumn("heading", F.last(F.when(F.col("level").isNotNull(), F.col("seq")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    counts = stage(rows.groupBy("file_ord", "heading").agg(F.count_if(F.col("level").isNull()).alias("sentences"), F.max("level").alias("level")), "sections")
    heads = counts.filter("heading IS NOT NULL").withColumnRenamed("heading", "seq").withColumn("next_level", F.lead("level").over(order)).drop("level")
    heads = elements.filter(F.col("type").isin(*LEVELS)).withColumn("level", level).join(heads, ["file_ord", "seq"])
    if scope == "file":
        return heads.withColumn("has_child", F.coalesce(F.col("next_level") > F.col("level"), F.lit(False)))
    files = counts.groupBy("file_ord").agg(F.min_by("level", "heading").alias("first_level"), F.coalesce(F.max(F.when(F.col("heading").isNull(), F.col("sentences"))), F.lit(0)).alias("leading"))
    summed = prefix_sum(files, "file_ord", "leading", "upto")
    total = F.broadcast(summed.agg(F.coalesce(F.max("upto"), F.lit(0)).alias("all")))  # one row
    with_heads = following(summed.filter("first_level IS NOT NULL"), "file_ord", ["first_level", "upto"]).crossJoin(total)
    more = with_heads.select("file_ord", F.col("next_first_level"), (F.coalesce("next_upto", "all") - F.col("upto")).alias("more"))
    out = heads.join(more, "file_ord")
    last = F.col("next_level").isNull()
    out = out.withColumn("sentences", F.col("sentences") + F.when(last, F.col("more")).otherwise(0))
    after = F.coalesce("next_level", "next_first_level")
    return out.withColumn("has_child", F.coalesce(after > F.col("level"), F.lit(False))).drop("next_first_level", "more")


def density(elements: DataFrame, minimum: int = 3, scope: str = "corpus") -> DataFrame:
    """Sections with fewer sentences than the minimum and no section inside."""
    found = section_counts(elements, scope).filter((F.col("sentences") < minimum) & ~F.col("has_child"))
    return _diagnostics(found, "density", F.concat(F.lit("章节“"), F.col("content"), F.lit("”过于简短，建议丰富内容。")))


def captions(elements: DataFrame) -> DataFrame:
    """Figures and tables without a caption."""
    found = elements.filter(F.col("type").isin("figure", "table") & ~F.coalesce("metadata.has_caption", F.lit(False)))
    return _diagnostics(found, "caption", F.concat(F.when(F.col("type") == "figure", "图").otherwise("表"), F.lit("缺少 \\caption{...}。")))


def analyze(elements: DataFrame, minimum: int = 3, scope: str = "corpus") -> DataFrame:
    """All four checks; `ord` has the checks' order."""
    parts = [punctuation(elements), abbreviations(elements), density(elements, minimum, scope), captions(elements)]
    out = None
    for i, part in enumerate(parts):
        part = part.withColumn("ord", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


def analyze_changed(elements: DataFrame, changed: DataFrame, since: tuple[int, int] | None, files: DataFrame, minimum: int = 3, scope: str = "corpus") -> DataFrame:
    """The checks for what changed: keys (element_key), first uses from `since` on, density of files (file_path), or of all in corpus scope."""
    own = elements.join(changed.select("element_key").distinct(), "element_key", "left_semi")
    counted = elements if scope == "corpus" else elements.join(files.select("file_path").distinct(), "file_path", "left_semi")
    parts = [punctuation(own), None if since is None else abbreviations(elements, since), density(counted, minimum, scope), captions(own)]
    return reduce(DataFrame.unionByName, [part.withColumn("ord", F.lit(i)) for i, part in enumerate(parts) if part is not None])
