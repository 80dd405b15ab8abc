"""Column functions: text rules, identities, decoding."""
