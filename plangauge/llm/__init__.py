"""Operators of a training-data pipeline over document tables.

Every operator takes a DataFrame with at least the columns it names and gives a
DataFrame back; :mod:`plangauge.llm.catalog` registers one query for each.
Nothing else in the library imports this package.
"""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
