"""Training-data operators: near-dedup, fingerprints, mixing, extraction, scans and classifiers."""
