"""Set-oriented Spark jobs for image-catalogue pipelines.

Every job takes DataFrames and returns DataFrames; Catalyst plans the work.
"""
