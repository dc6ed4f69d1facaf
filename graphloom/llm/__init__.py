"""Training-data operators: near duplicates, archives, media, sharding, language,
packing, personal data, mixing and page extraction.

Nothing outside this package imports it.
"""
