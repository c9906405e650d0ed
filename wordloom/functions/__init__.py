"""Column builders and driver-side helpers."""
