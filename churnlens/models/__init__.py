"""Spark ML layer: feature preparation, learners, the model catalogue and cross-validation."""
