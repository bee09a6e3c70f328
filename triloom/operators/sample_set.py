"""Sets of samples as one-column tables; the set algebra beside the three-valued one of `state`."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triloom.operators import state


@dataclass(frozen=True)
class SampleSet:
    """Distinct sample ids (sample_id); every operation is lazy but for those that give a number or truth."""

    ids: DataFrame

    @staticmethod
    def of(rows: DataFrame) -> SampleSet:
        return SampleSet(rows.where("sample_id is not null").select("sample_id").distinct())

    @staticmethod
    def empty(spark) -> SampleSet:
        return SampleSet(spark.createDataFrame([], "sample_id long"))

    def intersection(self, other: SampleSet) -> SampleSet:
        return SampleSet(self.ids.join(other.ids, "sample_id", "left_semi"))

    def union(self, *others: SampleSet) -> SampleSet:
        """One distinct over all sets, however many."""
        out = self.ids
        for o in others:
            out = out.union(o.ids)
        return SampleSet(out.distinct())

    def minus(self, *others: SampleSet) -> SampleSet:
        """Without the samples of any other set: one anti join with their union."""
        if not others:
            return self
        gone = others[0].union(*others[1:]) if len(others) > 1 else others[0]
        return SampleSet(self.ids.join(gone.ids, "sample_id", "left_anti"))

    def jaccard(self, other: SampleSet) -> DataFrame:
        """One row (jaccard)."""
        return state.jaccard(self.ids, other.ids)

    def described(self, sample_id: int) -> DataFrame:
        """One row: len, is_empty and whether the set contains a sample."""
        n = F.count("*")
        has = F.count_if(F.col("sample_id") == sample_id) > 0
        return self.ids.agg(n.alias("len"), (n == 0).alias("is_empty"), has.alias("contains"))

    def size(self) -> DataFrame:
        """One row (n)."""
        return self.ids.agg(F.count("*").alias("n"))

    def __len__(self) -> int:
        return self.ids.count()

    def __contains__(self, sample_id: int) -> bool:
        return not self.ids.where(F.col("sample_id") == sample_id).isEmpty()

    def is_empty(self) -> bool:
        return self.ids.isEmpty()
