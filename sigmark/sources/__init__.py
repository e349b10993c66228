"""Reading tables and artifacts, and binding them to the logical tables of the engine."""
