"""Column expressions; everything here stays inside the JVM unless its docstring says otherwise."""
