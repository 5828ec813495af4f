"""Inputs, outputs and generated worlds."""
