"""Training-data operators: dedup, cleaning, classification, packing and tokenization."""
