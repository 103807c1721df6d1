"""Part of the lead data engine."""
