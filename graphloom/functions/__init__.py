"""Column expressions: text extraction and rendering."""
