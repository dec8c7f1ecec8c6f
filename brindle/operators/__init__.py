"""Operators over counts, axes, latents and graphs."""
