"""chronofold.operators."""
