"""Column functions: transcripts, tokens, arrays, signals."""
