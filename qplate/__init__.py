"""qplate: quantitative-PCR plate analytics expressed as Spark DataFrame plans.

Every public operator is a pure ``DataFrame -> DataFrame`` function built on
Spark SQL aggregates, joins, windows and higher-order functions.  Nothing is
collected to the driver; per-group state is pre-aggregated before each shuffle
so that one hot replicate, sample or group never lands whole in one task.
"""

from qplate.config import AnalysisConfig

__all__ = ["AnalysisConfig"]
__version__ = "0.1.0"
