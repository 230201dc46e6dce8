"""Static tables that plans join with: the artifact catalog, rival hypotheses, timeline mappings."""
