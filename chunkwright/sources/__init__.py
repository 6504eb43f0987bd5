"""Reading documents and keeping chunks."""
