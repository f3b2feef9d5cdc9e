"""Part of stowage."""
