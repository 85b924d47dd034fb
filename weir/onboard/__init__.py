"""Onboarding of a new log source from sample lines: measure, propose, validate, approve."""
