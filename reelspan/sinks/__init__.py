"""Writers of timed text and records."""
