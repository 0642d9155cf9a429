"""Training-data operators: decontamination, near duplicates, archives, extraction, PII, LM scoring, dedup, quality, BPE."""
