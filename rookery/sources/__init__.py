from . import evidence, exports, readers  # noqa: F401
