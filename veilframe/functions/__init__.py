"""Part of veilframe."""
