"""Spark-native label compliance analytics.

DataFrame operators for label text (reading order, declaration extraction,
commodity class), hybrid retrieval over legal provisions (dense, BM25, intent
expansion, exact citation, reciprocal rank fusion, reranking), evidence and
verdict roll-ups, and retrieval-quality metrics.
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
