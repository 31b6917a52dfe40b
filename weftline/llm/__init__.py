"""Training-data operators: quality, secrets, tokenizers, media, language, toxicity, packing, rollups, joins."""
