"""Windows, late data and state over event streams."""
