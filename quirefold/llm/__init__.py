"""Training-data operators: archives, quality, fingerprints, decontamination, tokens, personal data, models, joins."""
