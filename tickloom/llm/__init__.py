"""Training-data operators: fixity, packing, toxicity, near-dedup, mixing, PII, search, LM scoring.

Nothing outside this subpackage imports it.
"""
