"""Task documents and the plans built from them."""
