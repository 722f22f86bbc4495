"""Column expressions shared by the jobs; all of them run inside the JVM."""
