"""Import every query module so the registry is complete."""

from eventide.plans import q_estimators  # noqa: F401
from eventide.plans import q_tests  # noqa: F401
from eventide.plans import q_profile  # noqa: F401
from eventide.plans import q_data  # noqa: F401
from eventide.plans import q_metrics  # noqa: F401
from eventide.plans import q_report  # noqa: F401
from eventide.plans import q_models  # noqa: F401
from eventide.plans import q_sources  # noqa: F401
from eventide.plans import q_more  # noqa: F401
from eventide.plans import q_ml  # noqa: F401
from eventide.plans import q_train  # noqa: F401
from eventide.plans import q_models2  # noqa: F401
from eventide.plans import q_fixed  # noqa: F401
