from . import jobs  # noqa: F401
