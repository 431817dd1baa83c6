"""eventide — time-to-event (survival) analytics as Spark DataFrame operators.

Every operator takes DataFrames and returns DataFrames.  Heavy work stays in
Spark (aggregations, windows, joins); only bounded tables (coefficients,
per-bucket totals, p x p matrices) ever reach the driver.
"""

from eventide.session import get_spark, checkpoint_dir
from eventide.spec import SurvivalSpec

__all__ = ["get_spark", "checkpoint_dir", "SurvivalSpec"]
