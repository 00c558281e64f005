"""Reading, typing and writing tables."""
