"""Part of the procuris engine: plans."""
