"""Training-data operators: sharding, dedup, language ID, licence scans, packing, search and scoring.

Nothing outside this subpackage imports it; the entry module adds its queries
only when it can be imported.
"""
