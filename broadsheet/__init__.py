"""broadsheet: a Spark-native engine for article ingestion, dedup, ranking and digests.

Every operator is a ``Column -> Column`` or ``DataFrame -> DataFrame`` function
built from Spark's own expressions, so Catalyst can prune, push down and fuse
them into whole-stage code.  Sub-packages:

* ``functions``  column expressions (whitespace, hashes, URLs, dates, HTML)
* ``sources``    scans: source lists, feeds, item arrays, seen log, library, pages
* ``operators``  extraction, ranking, dedup, summaries, digest, search
* ``plans``      whole jobs (batch ingest, daily digest, digest document)
* ``streaming``  incremental ingest on Structured Streaming
* ``sinks``      library / seen-log / digest writers
"""

__version__ = "0.1.0"
