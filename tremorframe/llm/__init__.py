"""Training-data operators: toxicity, media columns, quality rules, licence
scans, near-duplicate detection, HTML extraction, language-model scoring,
substring deduplication, source mixing and sequence packing.

Nothing outside this folder imports it.  Every operator is a function from
DataFrame to DataFrame; the thin contract queries are in ``queries``.
"""
