"""Stateful processors, each with the batch fold that it must agree with."""
