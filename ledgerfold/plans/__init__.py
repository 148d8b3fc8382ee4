"""Queries, versioned tables and the control plane."""
