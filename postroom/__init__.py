"""Message triage on Spark: clean, match, score, route, decide, report."""
