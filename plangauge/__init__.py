"""plangauge: query-workload analytics on PySpark.

Part A is a set of parameterized TPC-H style queries and rewrite pairs with a
distributed result-equality check.  Part B is batch and streaming analytics
over logs of query plans, rewrite attempts, timings, metric series and model
completions.  Everything is a DataFrame in, DataFrame out function.
"""

__version__ = "0.1.0"
