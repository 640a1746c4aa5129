"""demandloom: demand forecasting on large panels of daily series, as plain Spark jobs.

Every operator takes DataFrames and returns DataFrames. The shared table is the
long panel: one row per (series ``id``, integer day ``d``).
"""
