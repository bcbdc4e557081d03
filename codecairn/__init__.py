"""Repository analytics on Spark: every operator maps DataFrames keyed by ``repo_id`` to DataFrames."""
