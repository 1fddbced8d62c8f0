"""Training-data operators: decontamination, near-dedup, tokens, packing, sharding, text scans."""
