"""Operators of a training-data pipeline: near-duplicate joins, decontamination,
language and toxicity models, mixing, WARC archives, personal data, licences.

Each module holds one operator with a general interface; ``queries`` registers a
thin query per operator. Nothing outside this package imports it.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions that run in tasks are pickled by value, so executors need no copy of
# this package on their path.
register_pickle_by_value(sys.modules[__name__])
