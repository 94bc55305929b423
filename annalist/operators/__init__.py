"""DataFrame -> DataFrame operators, all lazy and without driver-side loops over rows."""
