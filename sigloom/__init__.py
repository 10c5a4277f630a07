"""Signal analytics on Spark: declarative operator graphs over time-ordered signals."""
