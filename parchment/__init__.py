"""Report-forensics analytics on Spark: parse, join, score and aggregate reports as Catalyst plans."""
