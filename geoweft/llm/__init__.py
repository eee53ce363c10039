"""Training-data operators: sharding, licence scans, near-duplicate joins, extraction, packing,
quality rules, suffix dedup, decontamination, line dedup and WARC revisits.

Nothing else in the library imports this subpackage.
"""
