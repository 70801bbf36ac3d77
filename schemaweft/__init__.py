"""Schema matching, legacy-schema transforms and match evaluation on Spark DataFrames.

Column names are rows: a catalog holds any number of (source schema, target schema)
pairs and every operator works on all pairs in one plan.
"""
