"""Plan-time choices: size bounds, lineage cuts, skew, and the query catalogue."""
