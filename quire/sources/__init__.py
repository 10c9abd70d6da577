"""Reading and writing PDF files."""
