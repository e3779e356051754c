"""The streaming of the library."""
