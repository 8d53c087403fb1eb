"""squall.streaming — incremental ingestion.

The reference has no streaming operators (every input is a whole file), so
nothing here changes query semantics: ``ingest`` turns the raw tower-file
reader (S1) into a Structured Streaming file source that appends cleaned
readings to a partitioned table exactly once; the batch operators then run
over that table.
"""
