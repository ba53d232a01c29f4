"""Text forms of numbers, sizes, paths and statistics."""
