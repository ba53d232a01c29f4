"""Log replay, file statistics, pruning: everything that becomes a Spark plan."""
