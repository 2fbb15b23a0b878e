"""The registered queries over the given tables; importing this registers them."""
