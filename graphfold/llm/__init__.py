"""Operators for training-data pipelines. Nothing else in graphfold imports this subpackage."""
