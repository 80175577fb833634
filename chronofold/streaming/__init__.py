"""chronofold.streaming."""
