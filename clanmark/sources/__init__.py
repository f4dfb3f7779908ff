"""Inputs, result tables and the shared work folder."""
