"""Reports, a pipeline runner, a command line and a JSON API over the engine."""
