"""Temporal key-value analytics on Spark: version chains, as-of reads, history, diffs, retention."""
