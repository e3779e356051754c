"""The functions of the library."""
