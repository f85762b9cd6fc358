"""Text functions and their column forms."""
