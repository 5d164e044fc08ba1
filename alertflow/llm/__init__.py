"""Training-data pipeline operators (near-dedup, search, decontamination, packing, ...)."""
