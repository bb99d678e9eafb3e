"""millrace: data pipelines, data quality and metric monitoring as Spark plans."""

import sys

from pyspark import cloudpickle

from .session import get_session

# Functions that run in tasks travel with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["get_session"]
