"""ordermill: order analytics on Spark.

Incremental ingestion into a partitioned bronze layer, latest-per-key cleaning
into silver, a gold star schema, change-event decoding and apply, streaming
order completion, catalogue normalisation with keyed upsert, and data-quality
checks. Operators are plain ``DataFrame -> DataFrame`` functions.
"""
