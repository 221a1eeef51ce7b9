"""From deliveries to the full set of stored tables."""
