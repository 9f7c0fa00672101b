"""Column -> Column functions. All run inside the JVM unless their docstring says otherwise."""
