"""Event-time streams."""
