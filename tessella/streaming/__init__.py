"""Nothing yet: the surveyed system has no streaming engine, and none is claimed."""
