"""Item taxonomies, embeddings and label concordance as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Task functions travel inside the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
