"""Operators for building language-model training data. Nothing else in polyview imports this package."""
