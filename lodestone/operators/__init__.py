"""Relational and order-dependent operators over DataFrames."""
