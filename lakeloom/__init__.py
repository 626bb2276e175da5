"""A lakehouse engine for retail data on Spark: declarative entities from raw text to a star schema."""
