"""The registered queries and, where SQL can say it, the same query for the oracle."""
