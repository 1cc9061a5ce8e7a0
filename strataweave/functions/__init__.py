"""Column expressions: paths, identifiers, canonical values."""
