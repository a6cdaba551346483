"""Training-data operators: ten corpus jobs, each ``DataFrame -> DataFrame``."""
