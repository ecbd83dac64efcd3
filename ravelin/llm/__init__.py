"""Operators that a training-data pipeline needs, each a set of Spark jobs.

Nothing outside this package imports it.  Every module holds one operator,
its thin registered query and, where SQL can say it, the query's SQL.
"""
