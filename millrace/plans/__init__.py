"""From SQL text to an ordered build: dialect, discovery, compilation, planning, running."""
