"""Operators of a training-data pipeline: ten independent modules, and `queries` that registers them."""
