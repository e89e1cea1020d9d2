"""Training-data operators: text quality, secrets, decontamination, toxicity,
archives, near duplicates, licences, language-model scores, mixing, token counts.

Nothing else in the library imports this subpackage.
"""
