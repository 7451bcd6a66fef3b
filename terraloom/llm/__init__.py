"""Training-data operators: quality, language, dedup, decontamination, tokenization, archives.

Nothing outside this subpackage imports it; it can be removed without touching the rest.
"""
