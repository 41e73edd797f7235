"""plans of the coupled-system engine."""
