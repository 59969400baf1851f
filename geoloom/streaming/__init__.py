"""The same surfaces over returns that keep arriving."""
