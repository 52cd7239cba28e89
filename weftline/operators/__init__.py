"""Operators of plan documents; ``registry`` names them all."""
