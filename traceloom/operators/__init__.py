"""Relational operators over traces, votes and checkpoints."""
