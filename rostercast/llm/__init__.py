"""Operators over text corpora: tokens, packing, near duplicates, extraction, secrets, shards, search, quality."""
