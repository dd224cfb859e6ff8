"""Ticket analytics on Spark: ingest, cleaning, operational metrics and text themes."""

# What tasks run of this package travels with them, so executors need no copy of it.
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
