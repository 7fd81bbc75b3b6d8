"""Record linkage operators: blocking, features, model, decisions, evaluation and quality rules."""
