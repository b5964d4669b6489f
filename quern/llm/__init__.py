"""Training-data operators: ten components and the queries that apply them."""
