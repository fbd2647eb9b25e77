"""marlstone: a library of DataFrame-to-DataFrame and stream-to-stream operators for Spark."""
