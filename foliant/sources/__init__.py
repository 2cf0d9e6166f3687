"""Readers that give the operators' tables."""
