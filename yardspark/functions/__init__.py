"""Column functions: text, geometry and geography."""
