"""Column helpers; every one of them is a plain JVM expression."""
