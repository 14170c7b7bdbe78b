"""Spark-native operators for fetched web pages, bilingual terms, translated segments and page regions."""

from pageloom.session import build_session

__all__ = ["build_session"]
