"""Hand-written parsers that say whether a file is valid, and why not."""
