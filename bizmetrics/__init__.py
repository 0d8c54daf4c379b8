"""Business analytics over sales, expense and inventory tables, on Spark.

Every operator takes DataFrames and returns a lazy DataFrame; the reference date
is always a parameter (``as_of``), never the clock.
"""
