"""Reading, checking, pairing, freezing and writing tables."""
