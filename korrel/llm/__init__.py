"""Training-data operators: deduplication, decontamination, counting, packing, scoring, formats."""
