"""Scalar building blocks: plain functions from Column to Column."""
