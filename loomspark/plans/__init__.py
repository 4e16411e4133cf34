"""Catalogue of queries; importing the package registers all of them."""

from loomspark.plans import catalog, coders, draws, packed, records  # noqa: F401
