"""tabtune: tabular cleaning, modelling and hyper-parameter search on Spark.

Every data-sized step is a DataFrame / Spark ML job; the driver only ever
sees per-column summaries and candidate populations (bounded by the number
of columns and the population size).
"""

import sys as _sys

try:  # ship our task functions by value: executors need no install of tabtune
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: package must be on executors
    pass

from tabtune.session import get_session, ensure_checkpoint_dir  # noqa: E402

__all__ = ["get_session", "ensure_checkpoint_dir"]
