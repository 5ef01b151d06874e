"""recut: relational analysis and re-cutting of catalogues of time-coded media on Spark."""
