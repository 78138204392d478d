from . import voice  # noqa: F401  registers its families beside those of signal
