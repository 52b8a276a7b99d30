"""Trajectory-similarity analytics for fleets of monitored objects, on Spark."""
