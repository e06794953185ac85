"""End-to-end pipelines composed from the operators."""
