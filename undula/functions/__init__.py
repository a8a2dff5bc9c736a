"""Part of undula."""
