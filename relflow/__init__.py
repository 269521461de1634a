"""relflow: pairwise-relation analytics and online factor models on Spark.

Every operator takes and returns DataFrames. Batch operators are plain
DataFrame plans; streaming operators are Structured Streaming queries.
"""

from relflow.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
