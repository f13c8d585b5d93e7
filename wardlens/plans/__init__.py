"""Multi-step jobs: feature table, training extract, panel and trends."""
