"""Training-data operators: dedup, packing, quality, licences, decontamination, tokens."""
