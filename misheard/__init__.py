"""Noisy-text analytics on Spark: clean, align, corrupt, tokenise, score."""

import sys

from pyspark import cloudpickle

# Arrow functions travel with their helpers, so workers need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
