"""Month counts of event streams."""
