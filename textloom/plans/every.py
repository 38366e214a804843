"""All registered queries: importing the modules registers them."""

from textloom.plans import catalogue, domain, registry, texts  # noqa: F401

QUERIES, ORACLES = registry.QUERIES, registry.ORACLES
