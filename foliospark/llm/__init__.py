"""Operators for preparing training text: deduplication, language, toxicity, personal data,
decontamination, tokens, vector search and page extraction. Nothing outside imports this."""
