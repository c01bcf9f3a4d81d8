"""Trusted-history analytics on Spark: stage, check, reconcile, merge, measure, publish."""
