"""Training-data pipeline operators (numbered 1-13), each in a module of its own.

Nothing outside this folder imports it except ``__spark_entry__`` and ``corpus_pipeline``.
"""
