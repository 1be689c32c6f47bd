"""Jobs: reports, incremental refresh, compaction."""
