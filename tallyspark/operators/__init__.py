"""Operators on games, teams, ratings, forecasts and simulations."""
