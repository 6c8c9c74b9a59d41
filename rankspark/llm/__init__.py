"""Operators for training-data pipelines (language ID, dedup, decontamination, mixing, scoring, ...).

Nothing else in the library imports this subpackage. Functions that run inside
Python workers are pickled by value, so executors need numpy, pyarrow and (for
two operators) pyahocorasick and xxhash, but not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
