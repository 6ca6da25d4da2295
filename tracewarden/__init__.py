"""Behavioural detection analytics on Spark: log features, detectors, fusion, drift and evaluation."""
