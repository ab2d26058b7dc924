"""Jobs: workspace, manifest, statistics and the deduplication job."""
