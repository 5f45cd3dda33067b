"""Physical-shape helpers: joins that survive hot keys, windows that survive hot series."""
