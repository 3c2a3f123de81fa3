"""Part of the procuris engine: functions."""
