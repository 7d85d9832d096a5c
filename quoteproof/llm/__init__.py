"""Training-data operators: fingerprints, mixing, PII, tokens, chat, joins, packing, files, dedup, quality."""
