"""Operators of a training-data pipeline; nothing else in kinsieve imports this subpackage."""
