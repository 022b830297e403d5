"""Registered queries over the driver's tables, and their SQL oracles."""
