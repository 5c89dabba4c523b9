"""Training-data operators: token counts, quality, chat, deduplication, sharding, packing, decontamination, vector search.

Nothing outside this package imports it.
"""
