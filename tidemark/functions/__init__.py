"""Column expressions: geometry, profiles, waves, climate, labels, identifiers."""
