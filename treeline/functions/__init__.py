"""Part of treeline."""
