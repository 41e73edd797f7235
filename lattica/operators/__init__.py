"""operators of the coupled-system engine."""
