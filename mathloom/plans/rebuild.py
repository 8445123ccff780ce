"""The deterministic rebuild: problems, candidates and judgments to training rows."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mathloom.functions import text as T
from mathloom.operators import curation, keyed
from mathloom.scratch import stage


class Rebuild:
    """Stages over one folder of tables; each is built once and only if something needs it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def source(self) -> DataFrame:
        return curation.source(self.table("problems"))

    @cached_property
    def candidates(self) -> DataFrame:
        return curation.candidates(self.table("solution_candidates"))

    def whole(self) -> Rebuild:
        """This rebuild with its candidates staged, for plans that read them several times."""
        if "staged_" not in self.__dict__:
            self.staged_ = self.candidates = stage(self.candidates, "candidates")
        return self

    @cached_property
    def _reconciled(self) -> tuple[DataFrame, DataFrame]:
        return curation.reconcile(self.candidates, self.source)

    @property
    def reconciled(self) -> DataFrame:
        return self._reconciled[0]

    @property
    def issues(self) -> DataFrame:
        return self._reconciled[1]

    @cached_property
    def eligible(self) -> DataFrame:
        return self.reconciled.where(curation.cheap_reason().isNull())

    @cached_property
    def unique(self) -> DataFrame:
        # Five stages read it.
        return stage(curation.near_dedup(self.eligible), "unique")

    @cached_property
    def independent(self) -> DataFrame:
        return curation.independent(self.candidates, self.table("deepseek_candidate_judgments"))

    @cached_property
    def judged(self) -> DataFrame:
        """Verifier judgments: the last of each candidate, verdict as stated but for blanks and case."""
        rows = keyed.last_by(self.table("deepseek_candidate_judgments").drop("appended_at"), curation.KEY)
        return rows.withColumn("verdict", F.upper(T.strip(F.col("verdict"))))

    @cached_property
    def judged_v1(self) -> DataFrame:
        rows = keyed.last_by(self.table("solution_judgments").drop("appended_at"), curation.KEY)
        return rows.withColumn("verdict", F.upper(T.strip(F.col("verdict"))))

    @cached_property
    def checks(self) -> DataFrame:
        return self.table("sympy_crosschecks").drop("appended_at").withColumn("status", F.upper(T.strip(F.col("status"))))

    @cached_property
    def profiled(self) -> DataFrame:
        self.whole()
        return curation.profile(self.source, self.reconciled, self.unique, self.independent, self.judged, self.checks, self.issues)

    @cached_property
    def queue(self) -> DataFrame:
        return curation.rejudge_queue(self.profiled)

    @cached_property
    def gated_v2(self) -> DataFrame:
        return curation.gate_v2(self.judged, self.unique, self.independent, self.source, self.checks, self.queue)

    @cached_property
    def sft_v2(self) -> DataFrame:
        accepted = self.gated_v2.where("reason is null")
        return curation.sft(curation.best(accepted), self.source, "verified")

    @cached_property
    def gated_v1(self) -> DataFrame:
        return curation.gate_v1(self.candidates, self.source, self.judged_v1)

    def sft_v1(self, missing: str = "final-only") -> DataFrame:
        accepted = self.gated_v1.where("reason is null")
        return curation.sft(curation.best(accepted, prefer_finished=True), self.source, "teacher-verified", missing)
