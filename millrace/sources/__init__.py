"""Where data comes from and goes to: driver tables, CSV seeds, the snapshot store."""
