"""revlens: a Spark-native library for review-table analytics.

Every operator is a ``DataFrame -> DataFrame`` function built from Spark SQL
expressions, window functions, ``pyspark.ml`` and Arrow (pandas) jobs.
"""

__version__ = "0.1.0"
