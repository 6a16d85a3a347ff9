"""Training-data operators: decontamination, deduplication, tokenisation, privacy, language and toxicity."""
