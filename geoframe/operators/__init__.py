"""Relational operators over cameras, images, matches, points and clouds."""
