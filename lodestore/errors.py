"""Errors with stable codes."""


class EngineError(Exception):
    code = "internal"


class ValidationError(EngineError):
    code = "validation"


class NotFoundError(EngineError):
    code = "not_found"


class ConflictError(EngineError):
    code = "conflict"


class EmbeddingError(EngineError):
    code = "embedding"


class StorageError(EngineError):
    code = "storage"
