"""Column functions: text cleaning, vectors, scores. All are built-in expressions, so plans stay on the JVM side."""
