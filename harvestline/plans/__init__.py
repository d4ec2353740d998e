"""Composed views: silver feeds, gold views, workflow steps, serving queries, model."""
