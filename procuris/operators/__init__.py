"""Part of the procuris engine: operators."""
