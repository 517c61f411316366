"""Training-data operators: near-duplicates, toxicity, decontamination,
tokenization, extraction, media, exact substring dedup, licenses, secrets."""
