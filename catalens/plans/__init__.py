"""Building blocks for plans that must hold up under skew and at scale."""
