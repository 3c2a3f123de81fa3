"""Part of the procuris engine: streaming."""
