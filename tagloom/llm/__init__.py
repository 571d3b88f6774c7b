"""Training-data operators: media columns, packing, token counts, suffix-array
dedup, secret scans, decontamination, toxicity, line dedup, sharding and SimHash
near-dedup.  Nothing outside this subpackage imports it."""
