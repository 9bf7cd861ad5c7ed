"""Plans: named relations and the queries over them."""
