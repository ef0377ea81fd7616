"""Finding, ranking and explaining the technical standards that a specification needs, on Spark."""
