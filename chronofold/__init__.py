"""chronofold: agent-memory ledgers and recall as Spark plans."""
