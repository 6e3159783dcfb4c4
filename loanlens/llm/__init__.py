"""Operators for preparing training data. Nothing else in the library imports this package.

Functions that run inside Arrow tasks are shipped by value, so executors need
numpy, pyarrow and the tokenizer libraries but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
