"""Training-data operators: quality, toxicity, rules, decontamination, dedup, secrets, tokens, licences.

Nothing outside this subpackage imports it.
"""
