"""Column builders: pure functions from columns to columns, all evaluated inside the JVM."""
