"""Registered queries of the audit operators, each with its equivalent SQL where SQL can say it."""
