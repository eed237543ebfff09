"""Workflow analytics on Spark: an invocation is a row, a workflow is a DataFrame-to-DataFrame function."""
