"""parlance: a Spark-first analytics engine for time-aligned, multi-speaker transcripts."""
