"""Spark-native analytics for coupled systems: panels, coupling, memory, capacity, hazard and alerts."""
