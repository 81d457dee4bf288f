"""Training-data operators: search, tokenising, digests, sharding, deduplication, packing, extraction, filtering.

Nothing else in ``noticeflow`` imports this subpackage.
"""
