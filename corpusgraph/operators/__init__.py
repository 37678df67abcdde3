"""DataFrame-level operators (pure ``DataFrame -> DataFrame`` functions)."""
