"""Column functions: text, vectors and rule classifiers."""
