"""Column functions of the profile engine: addresses and names."""
