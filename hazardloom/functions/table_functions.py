"""Table functions for SQL: curves as rows, by LATERAL join."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

CURVE = T.StructType([T.StructField("cause", T.IntegerType()), T.StructField("t", T.DoubleType()), T.StructField("cif", T.DoubleType()), T.StructField("survival", T.DoubleType())])


class _SurvivalCurve:
    """Rows (cause, t, cif, survival) of one predicted incidence at the times asked for.

    Arguments are a curve (an array of each cause's values on a grid), the grid's times and the times to look up. Values are those of the last
    grid point at or before a time, 0 before the first; survival is what no cause has taken. A null curve gives no rows.
    """

    @staticmethod
    def analyze(curve: AnalyzeArgument, grid: AnalyzeArgument, times: AnalyzeArgument) -> AnalyzeResult:
        nested = isinstance(curve.dataType, T.ArrayType) and isinstance(curve.dataType.elementType, T.ArrayType)
        if not nested or not all(isinstance(a.dataType, T.ArrayType) for a in (grid, times)):
            raise ValueError("survival_curve takes an array of curves, an array of grid times and an array of times")
        return AnalyzeResult(CURVE)

    def eval(self, curve, grid, times):
        if curve is None or grid is None or times is None:
            return
        grid = [float(g) for g in grid]
        for t in map(float, times):
            at = bisect_right(grid, t) - 1
            values = [float(c[at]) if at >= 0 else 0.0 for c in curve]
            left = 1.0 - sum(values)
            for cause, value in enumerate(values, 1):
                yield cause, t, value, left


def register_survival_curve(spark: SparkSession, name: str = "survival_curve") -> None:
    """Make ``name(curve, grid, times)`` known to SQL: ``SELECT .. FROM predictions, LATERAL survival_curve(cif, array(..), array(365, 730))``."""
    spark.udtf.register(name, udtf(_SurvivalCurve))
