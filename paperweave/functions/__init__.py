"""Column functions: identifiers, text, geometry."""
