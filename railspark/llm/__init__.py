"""Training-data operators: tokens, quality, language model, duplicates, packing, chat, WARC.

Nothing outside this package imports it; ``llm.entry`` holds the registered queries.
"""
