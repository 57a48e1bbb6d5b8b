"""Operations of a training-data pipeline: deduplication, filtering, scoring and packing.

Python functions of this package run inside tasks, so they are shipped by value:
executors need not have this repository on their path.
"""

from pyspark import cloudpickle

import graphloom

cloudpickle.register_pickle_by_value(graphloom)
