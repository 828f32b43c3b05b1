"""Plan helpers: cutting lineage, size-checked broadcasts, table access."""
