"""Named queries and their SQL equivalents."""

from corpusmill.plans import audits, crops, keys, labels, packs, series, signals, streams, texts  # noqa: F401
from corpusmill.plans.catalog import CATALOG  # noqa: F401
