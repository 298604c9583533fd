"""Training-data operators: URL filters, packing, sharding, dedup, search, tokenising, scans, language ID, chat.

Nothing outside this subpackage imports it. Each module holds one operator with a general interface; ``queries`` has the
thin registered queries and their SQL.
"""
