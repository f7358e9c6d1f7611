"""The engine: open a universe of packages, analyse a root, ask why something is kept, check whether a build may go on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.operators import emit, report
from provena.plans import analysis, explain
from provena.schemas import read_facts


@dataclass
class RootSpec:
    """A root by installed name, by directory, or by source path."""

    kind: str
    value: str

    @staticmethod
    def parse(text: str) -> RootSpec:
        if not text or "\0" in text:
            raise ValueError("a root is a package name or a path")
        if text.startswith(("./", "../", "/")) or "/" in text:
            return RootSpec("directory", text)
        if not text[0].isalpha() or text.endswith(".") or any(not (c.isalnum() or c == ".") for c in text):
            raise ValueError(f"no package name: {text}")
        return RootSpec("name", text)


class Engine:
    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], root: str, linked: list[str] = (), external: list[str] = ()):
        self.spark, self.tables = spark, tables
        self.options = analysis.Options(RootSpec.parse(root).value.rstrip("/").rpartition("/")[2], list(linked), list(external))
        self._done: analysis.Analysis | None = None

    @classmethod
    def open(cls, spark: SparkSession, path: str, root: str, **options) -> Engine:
        return cls(spark, read_facts(spark, path), root, **options)

    def analyze(self) -> analysis.Analysis:
        if self._done is None:
            self._done = analysis.analyze(self.spark, self.tables, self.options)
        return self._done

    def explanation(self) -> explain.Explanation:
        done = self.analyze()
        return explain.explain(done.nodes, done.edges, done.roots)

    def document(self) -> DataFrame:
        return explain.document(self.explanation())

    def why(self, target: str) -> DataFrame:
        return explain.why(self.analyze(), target)

    def paths(self, target: str) -> DataFrame:
        return explain.entries(self.analyze(), target)

    def blockers(self) -> DataFrame:
        return report.diagnostics_in_order(self.analyze().blockers)

    def check(self) -> DataFrame:
        """``ok`` and the report: a build may go on only without blockers."""
        return self.analyze().blockers.agg((F.count("*") == 0).alias("ok"), F.count("*").alias("blockers"))

    def report(self) -> DataFrame:
        return emit.build_report(self.analyze().blockers)
