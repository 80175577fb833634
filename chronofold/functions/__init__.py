"""Column functions: canonical values, texts and styles."""
