"""See README.md for what lives in this subpackage."""
