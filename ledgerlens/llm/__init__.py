"""Operators for training-data pipelines: each module holds one operator and is usable on its own."""
