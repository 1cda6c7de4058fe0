"""Column functions: normalization, word and domain detectors, message rules."""
