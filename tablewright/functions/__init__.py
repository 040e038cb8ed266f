"""Column expressions and naming rules. Everything here stays inside the JVM."""
