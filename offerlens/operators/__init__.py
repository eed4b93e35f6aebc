"""DataFrame operators over offer observations."""
