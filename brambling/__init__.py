"""brambling: analytics over document-derived business records, written as Spark DataFrame functions."""
