"""Training-data operators: token counts, quality, language, duplicates, leaks, mixing."""
