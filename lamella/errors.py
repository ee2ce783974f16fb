"""Two kinds of failure: the caller's request is wrong, or a file is."""


class ContractError(ValueError):
    """A declaration or request that can't be met. code names the rule."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


class CorruptFileError(RuntimeError):
    """Bytes that are no valid Parquet file."""


class UnsupportedError(NotImplementedError):
    """A feature of the format that Spark's writer or reader doesn't have."""
