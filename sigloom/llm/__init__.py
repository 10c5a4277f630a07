"""Training-data operators (quality, extraction, media, dedup, mixing) on Spark DataFrames.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries only when it
can be imported.
"""
