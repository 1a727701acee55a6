"""Operators for preparing training text: formatting, filtering, deduplication,
decontamination, mixing and token output. Nothing outside this subpackage
imports it."""
