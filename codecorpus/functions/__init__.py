"""Column-level helpers: text rules, path rules and fixed lookup values."""
