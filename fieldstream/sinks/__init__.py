"""Writers of readings, events and points."""
