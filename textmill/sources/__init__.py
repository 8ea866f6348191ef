"""Loaders that give the tables the operators work on."""
