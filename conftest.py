"""Makes the repository importable for the tests, wherever they are started."""
