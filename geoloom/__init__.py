"""geoloom: deterministic bulk processing of spatial and versioned records on Spark."""
