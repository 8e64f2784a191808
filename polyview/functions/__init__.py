"""Part of polyview."""
