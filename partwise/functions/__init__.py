"""Column functions: strings and vectors to numbers."""
