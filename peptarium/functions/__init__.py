"""Column functions: numeric coercion, keys, contig strings, sequences."""
