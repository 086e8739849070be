"""Logging to standard output and, if asked, to a file that is rotated."""

from __future__ import annotations

import logging
import sys
from logging.handlers import RotatingFileHandler

#: Size of a log file and how many are kept.
FILE_BYTES, FILES_KEPT = 5 * 1024 * 1024, 3


def get_logger(name: str = "foliospark", level: int = logging.INFO, path: str | None = None) -> logging.Logger:
    """The named logger; asking again adds no second handler."""
    logger = logging.getLogger(name)
    logger.setLevel(level)
    form = logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s")
    if not any(type(h) is logging.StreamHandler for h in logger.handlers):
        out = logging.StreamHandler(sys.stdout)
        out.setFormatter(form)
        logger.addHandler(out)
    if path and not any(isinstance(h, RotatingFileHandler) for h in logger.handlers):
        file = RotatingFileHandler(path, maxBytes=FILE_BYTES, backupCount=FILES_KEPT)
        file.setFormatter(form)
        logger.addHandler(file)
    logger.propagate = False
    return logger
