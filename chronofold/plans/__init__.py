"""chronofold.plans."""
