"""Column functions: canonical digests, binary numbers and times, names."""
