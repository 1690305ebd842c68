"""Registered queries: one Spark plan per operator key plus its SQL oracle."""
