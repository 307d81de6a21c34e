"""Column functions: ring hashes, vector clocks, text codecs."""
