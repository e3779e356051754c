"""The plans of the library."""
