"""Operators for training-data pipelines: archives, dedupe, filters, packing, chat."""
