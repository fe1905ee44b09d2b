"""From a blob's bytes to its facts."""
