"""Parsing, checking and reviewing a workspace, with state from run to run.

Every run gives the same diagnostics as one without state: what depends on a single element is taken
over for unchanged elements, first uses of acronyms for sentences before the first that changed, density
by file for files without a change; after a removal or a change of order what depends on either is
computed anew, as is density over the corpus. A sentence counts as reviewed only if it has a review under
the same settings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import checks, incremental, parser, reports, review
from inkwell.schema import Settings
from inkwell.sources import files as sources
from inkwell.sources.state import State, stage

ORDER = ["ord", "file_ord", "seq", "message"]


class Engine:
    def __init__(self, spark: SparkSession, root: str, settings: Settings = Settings(), provider: Callable[[str, str], str] | None = None):
        self.spark, self.state, self.settings, self.provider = spark, State(spark, root), settings, provider

    def parse(self, files: DataFrame, only: list[str] | DataFrame | None = None, force: bool = False) -> DataFrame:
        """Keyed elements of files (file_path, file_ord, text), saved as the current run. only: read just these, the rest from the last run."""
        if force:
            self.state.clear()
        cached = self.state.read("elements")
        if only is not None and cached is not None and not force:
            names = (self.spark.createDataFrame([(f,) for f in only], "file_path string") if isinstance(only, list) else only.select("file_path")).distinct()
            fresh = parser.elements(files.join(names, "file_path", "left_semi"))
            kept = cached.join(names, "file_path", "left_anti").join(files.select("file_path"), "file_path", "left_semi")
            place = files.select("file_path", F.col("file_ord").cast("long").alias("file_ord"))
            kept = kept.select(*fresh.columns).drop("file_ord").join(place, "file_path").select(*fresh.columns)
            found = kept.unionByName(fresh)
        else:
            found = parser.elements(files)
        self.state.write("elements", incremental.keyed(found))
        return self.state.read("elements")

    def logic(self, elements: DataFrame) -> DataFrame:
        """Diagnostics of the four checks, saved with the elements they were made for."""
        s, cached, known = self.settings, self.state.read("logic"), self.state.read("logic_keys")
        facts = {"minimum": s.minimum_sentences, "scope": s.density_scope}
        if cached is None or known is None or any(self.state.facts("logic_keys").get(k) != v for k, v in facts.items()):
            found = checks.analyze(elements, s.minimum_sentences, s.density_scope)
        else:
            found = self._logic_changed(elements, cached, known)
        self.state.write("logic", found)
        self.state.write("logic_keys", elements.select("element_key", "type", "file_ord", "seq"), **facts)
        return self.state.read("logic")

    def _logic_changed(self, elements: DataFrame, cached: DataFrame, known: DataFrame) -> DataFrame:
        """Cached diagnostics that still hold, at their present place, and the checks of what changed; together what a full run gives."""
        s = self.settings
        files = incremental.section_files(elements, known)
        at = incremental.earliest_changed(elements, known).first()
        since = None if at["file_ord"] is None else (at["file_ord"], at["seq"])
        if incremental.reordered(elements, known).limit(1).count():
            since, files = (-1, -1), elements.select("file_path")
        changed = incremental.changed(elements, known, "sentence", "figure", "table").select("element_key")
        again = incremental.recheck(elements, changed, since, elements.select("file_path") if s.density_scope == "corpus" else files)
        kept = incremental.rebound(incremental.still_valid(cached, elements, again, llm=False), elements)
        return kept.unionByName(checks.analyze_changed(elements, changed, since, files, s.minimum_sentences, s.density_scope))

    def changes(self) -> DataFrame | None:
        """How many elements the last run added and deleted, against the one before; None without two runs."""
        now, before = self.state.read("elements"), self.state.read("elements", back=1)
        return None if now is None or before is None else incremental.summary(incremental.difference(now, before))

    def llm(self, elements: DataFrame, parts: int = 1, progress: Callable[[DataFrame], None] | None = None) -> DataFrame:
        """Diagnostics of the model's review; only sentences without a review under these settings are asked.

        They are asked in `parts`; after each, reviews and diagnostics so far are saved, and the latter given to progress.
        """
        sentences, signature = checks.sentences(elements), incremental.config_signature(self.settings)
        known = self.state.read("reviews")
        if known is not None and self.state.facts("reviews").get("signature") != signature:
            known = None
        asks = self.provider is not None and self.settings.llm_enabled
        for i in range(parts if asks else 0):
            todo = sentences.filter(F.pmod(F.xxhash64("element_key"), F.lit(parts)) == i)
            todo = todo if known is None else todo.join(known.select("element_key"), "element_key", "left_anti")
            answers = stage(review.reviewed(todo, self.provider, self.settings.review_mode, self.settings.provider), "answers")
            good = answers.filter("error IS NULL").drop("error")
            kept = good if known is None else known.join(sentences.select("element_key"), "element_key", "left_semi").unionByName(good)
            self.state.write("reviews", kept, signature=signature)
            known = self.state.read("reviews")
            if i < parts - 1:
                found = self._reviewed(sentences, known)
                if progress is not None:
                    progress(found)
        if known is None:
            known = self.spark.createDataFrame([], "element_key string, provider string, raw string")
        found = self._reviewed(sentences, known)
        if asks and progress is not None:
            progress(found)
        return found

    def _reviewed(self, sentences: DataFrame, known: DataFrame) -> DataFrame:
        """Save and return the diagnostics of the known reviews."""
        rows = review.parsed_answers(sentences.join(known, "element_key"))
        found = review.diagnostics(review.accepted(review.issues(rows), self.settings.review_mode)).withColumn("ord", F.lit(0))
        self.state.write("llm", found)
        return self.state.read("llm")

    def full(self, files: DataFrame, only: list[str] | DataFrame | None = None, force: bool = False) -> DataFrame:
        """All diagnostics: first the checks', then the model's."""
        elements = self.parse(files, only, force)
        return incremental.combined(self.logic(elements), self.llm(elements))

    def refresh(self, files: DataFrame, saved: list[str] | DataFrame) -> DataFrame:
        """A run after saves: all of the saved files (names, or a table with file_path) are read again."""
        return self.full(files, only=saved)

    def restore(self) -> DataFrame | None:
        """The last run's diagnostics, by file, as they were published."""
        found = [x for x in (self.state.read("logic"), self.state.read("llm")) if x is not None]
        return self.publish(incremental.combined(*found)) if found else None

    @staticmethod
    def publish(diagnostics: DataFrame) -> DataFrame:
        return reports.by_file(diagnostics, ORDER)

    def export(self, path: str, files: DataFrame | None = None) -> None:
        """Write the last run's elements as JSON lines; without one, run first."""
        elements = self.state.read("elements")
        if elements is None:
            if files is None:
                raise ValueError("there is no run to export, and no files to make one from")
            self.full(files)
            elements = self.state.read("elements")
        incremental.in_position(elements).write.mode("overwrite").json(path)

    def write_log(self, path: str, elements: DataFrame) -> None:
        """The model's reviews as JSON lines: sentence, prompt, answer, issues, rewrite."""
        known = self.state.read("reviews")
        if known is not None:
            rows = review.parsed_answers(checks.sentences(elements).join(known, "element_key"))
            rows.withColumn("prompt", review.user_prompt(F.col("content"), self.settings.review_mode)).write.mode("overwrite").json(path)


def open_workspace(spark: SparkSession, root: str) -> DataFrame:
    return sources.in_order(sources.tex_files(spark, root))
