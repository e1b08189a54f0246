"""Column functions: model scales, names, and text extraction."""
