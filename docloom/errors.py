"""What can be wrong with a request."""


class DocloomError(Exception):
    pass


class BadFilter(DocloomError):
    pass


class BadQuery(DocloomError):
    pass


class BadPipeline(DocloomError):
    pass


class BadUpdate(DocloomError):
    pass


class Conflict(DocloomError):
    """A revision, or a token older than what is kept, no longer fits."""


class DuplicateKey(Conflict):
    pass


class AlreadyExists(DocloomError):
    pass


class NotFound(DocloomError):
    pass


class LimitExceeded(DocloomError):
    pass


class BadDump(DocloomError):
    pass
