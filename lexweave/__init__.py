"""lexweave: labelled short-text corpora as Spark DataFrame jobs."""
