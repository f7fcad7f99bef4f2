"""Training-data operators: one module each, with its query beside it; `registry` lists the queries."""
