"""Corpus preparation, tokenizer training, packing, epoch planning and scoring on Spark."""

import sys

from pyspark import cloudpickle

# Functions travel to the workers whole, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
