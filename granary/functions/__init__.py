"""Column functions over documents and conversations."""
