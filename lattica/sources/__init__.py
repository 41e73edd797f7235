"""sources of the coupled-system engine."""
