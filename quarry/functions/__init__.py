"""Column functions: text, paths, classification, signals and scores.  All run inside the JVM."""
