"""The interval verbs."""
