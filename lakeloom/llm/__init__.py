"""Training-data operators: quality rules, de-duplication, privacy, mixing, packing.

Nothing outside this subpackage imports it, so that it can be removed as a unit.
"""
