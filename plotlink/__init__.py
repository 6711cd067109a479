"""plotlink: building-footprint conflation and training-data operators on Spark."""
