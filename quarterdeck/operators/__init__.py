"""Dataframe operators of the engine."""
