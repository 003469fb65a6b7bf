"""Operators for training-data pipelines: mixing, quality, near copies, licences, shards, leakage, token files, language models, chat."""
