"""Evidence-first candidate search as Spark DataFrame transformations."""

from evidex.corpus import Corpus, empty_corpus

__all__ = ["Corpus", "empty_corpus"]
