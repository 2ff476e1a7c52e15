"""hazardloom: competing-risks survival analytics on Spark DataFrames."""

from .operators.concordance import compute_uno_weights, concordance_index_cr, concordance_index_uno_cr
from .operators.evaluation import ScoreResult, calibration_cr, score_cr
from .operators.forest import CompetingRiskForest
from .operators.gray import GrayTestResult, gray_test
from .operators.incidence import CumulativeIncidence
from .operators.regression import CauseSpecificCox, FineGrayRegression, PenalizedFineGrayRegression
from .sources.outcomes import Surv

__all__ = [
    "CauseSpecificCox",
    "CompetingRiskForest",
    "CumulativeIncidence",
    "FineGrayRegression",
    "GrayTestResult",
    "PenalizedFineGrayRegression",
    "ScoreResult",
    "Surv",
    "calibration_cr",
    "compute_uno_weights",
    "concordance_index_cr",
    "concordance_index_uno_cr",
    "gray_test",
    "score_cr",
]
__version__ = "0.1.0"
