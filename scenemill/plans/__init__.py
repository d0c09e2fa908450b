"""Query registry: operators bound to the plain parquet tables."""
