"""SQL function equivalents that Spark spells differently."""
