"""Governed lakehouse operators for PySpark: every operator takes and returns DataFrames."""

from pyspark import cloudpickle as _cloudpickle

#: functions of this package travel to the executors by value, so they need no copy of it
_cloudpickle.register_pickle_by_value(__import__("sys").modules[__name__])

__version__ = "0.1.0"
