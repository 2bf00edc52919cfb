"""A stored state of numeric columns that grows by batches: deciles and moments without the old rows.

A batch adds three tables. Its values are counted per different value and written in order of column and
magnitude, so that a reader of a few magnitudes skips the other files and row groups. Its moments are a
mergeable state of one row for each column. Its histogram has a row for each magnitude, which add up over
batches; it is written last and is the mark of a complete batch. One that was cut short is not seen, and
one that is written again replaces itself, so each batch counts once.

Quantiles are exact: the summed histograms say which magnitudes hold the wanted ranks, and only the
counted values of these are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.moments import fold_moments, moment_state, moments_of
from millrace.operators.quantiles import DECILES, histogram, quantiles_of, value_counts
from millrace.workspace import stored

#: Moments are kept up to this order.
HIGHEST = 4


class NumberStore:
    """The state of some columns below a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def add(self, df: DataFrame, columns: Sequence[str], batch: str) -> None:
        """Counts the rows of a batch; the same batch again takes its place."""
        state = fold_moments(moment_state(df, columns, HIGHEST), highest=HIGHEST)
        state.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/moments/batch={batch}")
        counts = stored(value_counts(df, columns), "value_counts")
        ordered = counts.repartitionByRange("column", "octave").sortWithinPartitions("column", "octave", "value")
        ordered.write.mode("overwrite").parquet(f"{self.root}/values/batch={batch}")
        whole = histogram(counts)
        whole.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/histogram/batch={batch}")

    def batches(self) -> list[str]:
        """The complete batches."""
        try:
            found = self.spark.read.parquet(f"{self.root}/histogram").select(F.col("batch").cast("string"))
        except AnalysisException as error:
            if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return []
            raise
        return sorted(r.batch for r in found.distinct().collect())

    def _read(self, table: str) -> DataFrame:
        paths = [f"{self.root}/{table}/batch={b}" for b in self.batches()]
        if not paths:
            raise ValueError(f"no complete batch below {self.root}")
        return self.spark.read.parquet(*paths)

    def histogram(self) -> DataFrame:
        """Rows (column, octave, n, kinds, low, high) of all batches; `kinds` counts a value once for each batch."""
        measures = [F.sum("n").alias("n"), F.sum("kinds").alias("kinds"), F.min("low").alias("low"), F.max("high").alias("high")]
        return self._read("histogram").groupBy("column", "octave").agg(*measures)

    def quantiles(self, probabilities: Sequence[float] = DECILES) -> DataFrame:
        """Rows (column, probability, quantile) over the rows of all batches."""
        return quantiles_of(self._read("values"), probabilities, self.histogram())

    def moments(self, columns: Sequence[str], highest: int = HIGHEST) -> DataFrame:
        """Rows (column, order, moment) over the rows of all batches."""
        if highest > HIGHEST:
            raise ValueError(f"moments are kept up to order {HIGHEST}")
        return moments_of(self._read("moments"), columns, highest)
