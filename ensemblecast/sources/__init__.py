"""Tables of series, and the stores for what is computed from them."""
