"""Training-data operators: quality rules, token counts, near duplicates, mixing, URL lists,
media payloads, personal data, quality and language models, and sequence packing.

Nothing outside this subpackage imports it.
"""
