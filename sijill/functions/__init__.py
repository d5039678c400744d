"""Part of sijill."""
