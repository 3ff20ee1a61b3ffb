"""Folio: customer-account portfolio analytics on Spark DataFrames."""
