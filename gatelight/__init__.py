"""Permission-aware document retrieval, upkeep and evaluation as Spark jobs."""
