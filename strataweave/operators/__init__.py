"""DataFrame-to-DataFrame operators: alignment, units, diff, apply, references."""
