"""Content-addressed elements, and what changed between two runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inkwell.functions.ordering import following
from inkwell.functions.text import content_hash
from inkwell.schema import LEVELS, RANGE, Settings


def keyed(elements: DataFrame) -> DataFrame:
    """elements with content_hash, occurrence (of equal ones in the file, from 0) and element_key."""
    out = elements.withColumn("content_hash", content_hash(F.col("content")))
    out = out.withColumn("occurrence", (F.row_number().over(W.partitionBy("file_path", "type", "content_hash").orderBy("seq")) - 1).cast("int"))
    return out.withColumn("element_key", F.concat_ws(":", "file_path", "type", "content_hash", F.col("occurrence").cast("string")))


def key_by_location(elements: DataFrame) -> DataFrame:
    """(file_path, range) to element_key; of several the last."""
    return elements.groupBy("file_path", *RANGE).agg(F.max_by("element_key", "seq").alias("element_key"))


def with_keys(diagnostics: DataFrame, elements: DataFrame) -> DataFrame:
    """diagnostics with the key of the element at their range, or null."""
    return diagnostics.drop("element_key").join(key_by_location(elements), ["file_path", *RANGE], "left")


def difference(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(element_key, type, status): new, unchanged or removed."""
    now = current.select("element_key", F.col("type").alias("now"))
    old = previous.select(F.col("element_key").alias("old_key"), F.col("type").alias("old"))
    joined = now.join(old, F.col("element_key") == F.col("old_key"), "full_outer")
    status = F.when(F.col("old_key").isNull(), "new").when(F.col("element_key").isNull(), "removed").otherwise("unchanged")
    return joined.select(F.coalesce("element_key", "old_key").alias("element_key"), F.coalesce("now", "old").alias("type"), status.alias("status"))


def summary(diff: DataFrame) -> DataFrame:
    return diff.agg(F.count_if(F.col("status") == "new").alias("added"), F.count_if(F.col("status") == "removed").alias("deleted"), F.count_if((F.col("status") == "removed") & (F.col("type") == "sentence")).alias("deleted_sentences"))


def baseline_keys(diagnostics: DataFrame, recorded: DataFrame | None = None) -> DataFrame:
    """The keys a run recorded, or else those of its diagnostics."""
    return (recorded if recorded is not None else diagnostics.filter("element_key IS NOT NULL")).select("element_key").distinct()


def changed(elements: DataFrame, baseline: DataFrame, *types: str) -> DataFrame:
    """Elements of the given types that the baseline doesn't have."""
    return elements.filter(F.col("type").isin(*types)).join(baseline.select("element_key"), "element_key", "left_anti")


def removed(current: DataFrame, baseline: DataFrame) -> DataFrame:
    return baseline.join(current.select("element_key"), "element_key", "left_anti")


def earliest_changed(elements: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row (file_ord, seq): the first sentence to look at again; (-1, -1) after a removal, nulls if nothing changed."""
    first = changed(elements, baseline, "sentence").agg(F.min(F.struct("file_ord", "seq")).alias("p"))
    gone = removed(elements, baseline).limit(1).agg((F.count("*") > 0).alias("gone"))
    start = lambda c: F.when(F.col("gone"), F.lit(-1).cast("long")).otherwise(F.col(f"p.{c}")).alias(c)
    return first.crossJoin(F.broadcast(gone)).select(start("file_ord"), start("seq"))  # one row each


def section_files(elements: DataFrame, baseline: DataFrame) -> DataFrame:
    """Files whose sections have to be counted again: all with sections after a removal, else those with a new sentence or section."""
    sections = elements.filter(F.col("type").isin(*LEVELS))
    gone = removed(elements, baseline).limit(1).select(F.lit(True).alias("gone"))
    everything = sections.select("file_path").join(F.broadcast(gone), F.lit(True), "left_semi")
    return everything.unionByName(changed(elements, baseline, "sentence", *LEVELS).select("file_path")).distinct()


def reordered(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Rows only if elements that both have stand in another order: (element_key, file_ord, seq) of either."""
    old = baseline.select("element_key", F.col("file_ord").alias("old_file"), F.col("seq").alias("old_seq"))
    both = current.select("element_key", "file_ord", "seq").join(old, "element_key")
    before = F.lag("old_seq").over(W.partitionBy("file_ord").orderBy("seq"))
    inside = both.withColumn("before", before).filter("old_seq < before").select("file_ord")
    files = following(both.groupBy("file_ord").agg(F.min("old_file").alias("old_file")), "file_ord", ["old_file"])  # a row per file
    return inside.unionByName(files.filter("next_old_file < old_file").select("file_ord"))


def suffix(sentences: DataFrame, file_ord: int, seq: int) -> DataFrame:
    return sentences.filter(F.struct("file_ord", "seq") >= F.struct(F.lit(file_ord).cast("long"), F.lit(seq).cast("long")))


def section_keys(elements: DataFrame, files: DataFrame) -> DataFrame:
    """Keys of the sections in the files."""
    return elements.filter(F.col("type").isin(*LEVELS)).join(files.select("file_path").distinct(), "file_path", "left_semi").select("element_key")


def recheck(elements: DataFrame, own: DataFrame, since: tuple[int, int] | None, files: DataFrame) -> DataFrame:
    """(rule, element_key) to check again: the changed elements by themselves, first uses from `since` on, the sections of files."""
    parts = {"punctuation": own, "caption": own, "density": section_keys(elements, files)}
    if since is not None:
        parts["abbreviation"] = suffix(elements.filter("type = 'sentence'"), *since)
    found = [part.select(F.lit(rule).alias("rule"), "element_key") for rule, part in parts.items()]
    return reduce(DataFrame.unionByName, found)


def is_llm(source: Column) -> Column:
    return source.startswith("LLM:")


def still_valid(cached: DataFrame, current: DataFrame, recheck: DataFrame, llm: bool) -> DataFrame:
    """Cached diagnostics of one kind whose key is current and isn't checked again under the same rule.

    recheck: (rule, element_key).
    """
    kind = is_llm(F.col("source")) if llm else F.col("source").isNotNull() & ~is_llm(F.col("source"))
    out = cached.filter(kind).join(current.select("element_key").distinct(), "element_key", "left_semi")
    return out.join(recheck.select("rule", "element_key").distinct(), ["rule", "element_key"], "left_anti")


def rebound(cached: DataFrame, current: DataFrame) -> DataFrame:
    """Cached diagnostics at the present place of their element; where it is gone, at the cached one."""
    places = (*RANGE, "file_ord", "seq")
    now = current.select("element_key", *[F.col(c).alias(f"now_{c}") for c in places])
    out = cached.join(now, "element_key", "left")
    return out.select(*[F.coalesce(f"now_{c}", c).alias(c) if c in places else F.col(c) for c in cached.columns])


def merged(cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """Cached elements of files that weren't read again, and the fresh ones."""
    return cached.join(fresh.select("file_path").distinct(), "file_path", "left_anti").unionByName(fresh)


def in_position(elements: DataFrame) -> DataFrame:
    return elements.orderBy(F.collate("file_path", "UNICODE"), "file_path", *RANGE, F.collate("type", "UNICODE"))


def combined(*parts: DataFrame) -> DataFrame:
    """Cached logic, cached model, fresh logic, fresh model diagnostics, in this order (ord)."""
    out = None
    for i, part in enumerate(parts):
        part = part.drop("ord").withColumn("ord", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def config_signature(s: Settings) -> str:
    """What model results depend on. Never has a key."""
    import json

    names = ("provider", "review_mode", "openai_model", "openai_base_url", "ollama_endpoint", "ollama_model")
    return json.dumps({n: getattr(s, n).strip() for n in names})

