"""Training-data operators: one module per operator, each with a general interface and one thin query."""
