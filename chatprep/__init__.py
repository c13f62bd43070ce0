"""Chat training data and agent transcripts as Spark tables."""
