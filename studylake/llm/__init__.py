"""Training-data operators: PII, near-dedup, tokenizers, decontamination, toxicity, licences, media, HTML.

Nothing else in the library imports this subpackage.
"""
