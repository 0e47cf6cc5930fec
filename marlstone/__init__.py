"""Governed analytics on Spark: plan policy, scoped views, operator library."""
