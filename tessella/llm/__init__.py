"""Training-data operators: deduplication, scanning, tokenising, packing, scoring and classification of text corpora.

Nothing outside this subpackage imports it; ``tessella.llm.entries`` holds the registered queries.
"""
