"""Registered queries; importing any of them registers all."""

from touchline.plans import registry  # noqa: F401
