"""See the README for what this part of the library does."""
