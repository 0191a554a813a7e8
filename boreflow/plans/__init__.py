"""Plans: series arrays, forecasters, the forecast run and the query registry."""
