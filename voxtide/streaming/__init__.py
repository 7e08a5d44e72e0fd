"""Operators on streams of images and particle positions."""
