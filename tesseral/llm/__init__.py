"""Corpus operators: survivors of duplicates, tokenising, packing, personal information. Nothing outside imports this."""
