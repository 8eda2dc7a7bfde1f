"""seasonlens."""
