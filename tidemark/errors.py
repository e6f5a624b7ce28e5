"""Errors, with the status that a server in front of the client would answer with."""


class EngineError(Exception):
    status = 500


class InvalidRequest(EngineError):
    status = 400


class DimensionMismatch(InvalidRequest):
    pass


class DistanceMetricConflict(EngineError):
    status = 409


class NamespaceNotFound(EngineError):
    status = 404


class NamespaceExists(EngineError):
    status = 409


class IndexNotBuilt(EngineError):
    pass


class CommitConflict(EngineError):
    pass


class ManifestUnreadable(EngineError):
    pass
