"""Structured Streaming forms of the operators (I1, I2, E1/E5/E6 stream twins)."""
