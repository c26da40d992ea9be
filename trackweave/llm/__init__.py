"""Training-data pipeline operators; optional: nothing else in the library imports this subpackage."""
