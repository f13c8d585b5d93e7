"""Query registry and SQL oracles over the driver's test tables."""
