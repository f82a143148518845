"""What models and parsers give, behind small interfaces, with deterministic stand-ins."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweir.functions import text as T


class Embedder(Protocol):
    def embed(self, text: Column) -> Column: ...


class HashingEmbedder:
    """Counts of hashed words, in the sense of feature hashing, as a column expression."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, text: Column) -> Column:
        slots = F.transform(T.tokens(text), lambda w: F.pmod(F.xxhash64(w), F.lit(self.size)))
        return F.transform(F.sequence(F.lit(0), F.lit(self.size - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("float"))


class Planner(Protocol):
    def plan(self, question: Column) -> Column: ...


class ClausePlanner:
    """Sub-goals are a question's clauses, six at most."""

    def plan(self, question: Column) -> Column:
        parts = F.filter(F.transform(F.split(T.normalize_question(question), r"(?U)[?;]|\s+(?:and|và|und|et|y)\s+"), T.strip), lambda c: c != "")
        return F.slice(F.when(F.size(parts) > 0, parts).otherwise(F.array(question)), 1, 6)


def contextual_prefix(raw: Column) -> Column:
    """The first sentence, 120 characters at most."""
    return F.left(F.regexp_extract(T.strip(raw), r"(?s)^(.*?[.!?])(?:\s|$)", 1), F.lit(120))


class Rewriter(Protocol):
    def rewrite(self, question: Column) -> Column: ...


class ClauseRewriter:
    """What follows a greeting or a polite opening, as a model would be asked to leave it out; null where that is
    the whole question."""

    #: Openings that say nothing of what is asked for.
    OPENINGS = r"(?iU)^\s*(?:xin chào|chào bạn|cho (?:tôi|mình) hỏi|please|hello|could you tell me)[\s,:!.]*"

    def rewrite(self, question: Column) -> Column:
        return F.nullif(T.strip(F.regexp_replace(question, self.OPENINGS, "")), F.lit(""))


def rewritten(question: Column, rewriter: Rewriter | None = None) -> Column:
    """The rewriter's question; without a rewriter, or where it gives nothing, the normalized one."""
    normal = T.normalize_question(question)
    return normal if rewriter is None else F.coalesce(F.nullif(T.strip(rewriter.rewrite(normal)), F.lit("")), normal)
