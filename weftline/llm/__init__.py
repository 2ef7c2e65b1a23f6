"""Training-data operators: one module for each, every one a ``DataFrame -> DataFrame`` function."""
