"""Sequences of readouts that go on arriving."""
