"""Whole plans: feature sets, training, inference and evaluation."""
