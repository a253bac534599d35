"""Training-data operators: secrets, near and exact duplicates, quality, search, packing, decontamination, scoring, language."""
