"""Training-data operators: thirteen corpus jobs on Spark.

Nothing outside this subpackage imports it; `queries.py` here holds the
registered queries.
"""
