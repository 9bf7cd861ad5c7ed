"""The engine's operators, by subject; importing a module adds its relations and queries to the catalogue."""
