"""Column helpers; all JVM-side unless a docstring says otherwise."""
