"""Training-data operators (ten components); nothing else in the library imports this package."""
