"""Part of the tessella analytics engine."""
