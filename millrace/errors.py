"""Errors of the engine. Statement errors carry the position in the script."""


class EngineError(Exception):
    pass


class ParseError(EngineError):
    def __init__(self, message: str, position: int = -1):
        super().__init__(f"{message} (at {position})" if position >= 0 else message)
        self.position = position


class MissingTable(EngineError):
    pass


class TableExists(EngineError):
    pass


class ConstraintViolation(EngineError):
    pass


class PermissionDenied(EngineError):
    pass
