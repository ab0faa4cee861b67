"""Column expressions: kernels, text and vector functions.  All run inside the JVM unless they say otherwise."""
