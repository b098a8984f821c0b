"""Features, validation, models and monitoring."""
