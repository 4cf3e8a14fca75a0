"""Training-data operators: deduplication, quality, language, mixing, archives, sharding, segmentation.

Each module holds one operator with a general interface; ``queries`` holds the
thin queries registered by ``__spark_entry__`` and ``oracle`` their DuckDB SQL.
Nothing outside this package imports it.
"""
