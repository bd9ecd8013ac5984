"""Column functions: text, telephone numbers, identifiers, places, pages, dates."""
