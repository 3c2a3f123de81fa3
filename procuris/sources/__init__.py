"""Part of the procuris engine: sources."""
