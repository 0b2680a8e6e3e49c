"""Training-data operators (dedup, language ID, extraction, packing, archives, URL rules, mixing)."""
