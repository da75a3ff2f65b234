"""What the operators refuse."""


class CausalError(ValueError):
    """A request that has no answer, with the reason."""
