"""The registered queries, each with its SQL for the oracle where SQL can say it."""
