"""ionquarry: spectral-library search on Spark."""
