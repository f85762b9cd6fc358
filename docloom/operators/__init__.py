"""Set-at-a-time operators over the canonical tables."""
