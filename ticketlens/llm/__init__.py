"""Training-data operators: quality, toxicity, deduplication, licences, decontamination, resampling, chat, tokens, URLs, WARC.

Nothing else in the library imports this subpackage.
"""
