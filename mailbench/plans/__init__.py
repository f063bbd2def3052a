"""The reports a user asks for, composed of the operators."""
