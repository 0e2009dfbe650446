"""Training-data operators: ten corpus operations, their queries and their oracle SQL."""
