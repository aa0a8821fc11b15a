"""See the package docstring of the library."""
