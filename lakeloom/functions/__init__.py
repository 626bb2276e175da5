"""Part of the lakehouse engine."""
