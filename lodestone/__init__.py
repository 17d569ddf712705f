"""Lodestone: Spark jobs for source-code and document collections."""
