"""Entry points (prepare, model search, holdout evaluation, monthly roster) and the query registry."""
