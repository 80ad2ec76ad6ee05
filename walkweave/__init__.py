"""Knowledge-graph walk corpora and entity vectors on Spark."""
