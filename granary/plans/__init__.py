"""How plans are run: tables that outlive executors, and whole corpus builds."""
