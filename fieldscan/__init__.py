"""Spark operators for recorded robot telemetry, lidar points and layered grid maps."""
