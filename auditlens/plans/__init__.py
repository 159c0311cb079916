"""Compositions of operators: cleaning flows, model evaluation, detector comparison."""
