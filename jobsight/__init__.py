"""jobsight: a Spark-native engine for job-posting data.

Pages arrive as tables; postings are extracted, normalized with Catalyst
expressions, fuzzy-deduplicated inside a company by a pruned self-join, kept
current by a lifecycle (new / updated / unchanged / inactive) and reported on.
Every operator takes and returns DataFrames; nothing is collected to the
driver except loop-termination counts.
"""

import sys as _sys

from jobsight.session import build_session, checkpoint_dir

try:  # ship UDF / mapInPandas code by value: workers need not have the package installed
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass

__all__ = ["build_session", "checkpoint_dir"]
