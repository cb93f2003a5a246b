"""Spatial tissue-graph analytics on PySpark.

Images, cell tables, matrix patches and spatial graphs are DataFrames that carry
a ``sample_id``; every analysis is a join, aggregation, window or grouped Arrow
function that Spark plans and distributes.  There is no loop over samples.
"""

__version__ = "0.1.0"
