"""Sources: repository discovery and cloning."""
