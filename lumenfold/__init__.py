"""Text intelligence over large collections of short texts, as Spark jobs."""
