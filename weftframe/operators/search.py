"""Full-text search: postings of word forms, signed terms, additive scores."""

from __future__ import annotations

import shlex
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import words as W
from ..plans.order import columns as order_columns

PLUS, MINUS, PLAIN = 1000, -1000, 100
#: What a task's Python holds at a time: rows and bytes of a batch of texts, bytes of texts as words, words with their forms.
ROWS, BATCH, PIECE, KNOWN = 1000, 1 << 23, 1 << 20, 1 << 16


@dataclass
class Query:
    """weights by word form in the order in which terms count; required: groups of forms of which one must be there; excluded: forms."""

    weights: dict[str, int] = field(default_factory=dict)
    required: list[list[str]] = field(default_factory=list)
    excluded: set[str] = field(default_factory=set)


def parse(query: str | Iterable[str], stopwords: frozenset[str]) -> Query:
    terms = shlex.split(query.strip()) if isinstance(query, str) else list(query)
    plus: dict[str, None] = {}
    minus: dict[str, None] = {}
    plain: dict[str, None] = {}
    out = Query()
    for term in terms:
        sign = next((s for s in ("++", "--", "+", "-") if term.startswith(s)), "")
        forms = list(dict.fromkeys(W.words(term[len(sign) :], stopwords)))
        if sign == "++":
            out.required.append(forms)
        if sign == "--":
            out.excluded.update(forms)
        for f in forms:
            if sign in ("+", "++"):
                minus.pop(f, None)
                plus[f] = None
            elif sign in ("-", "--"):
                plus.pop(f, None)
                minus[f] = None
            elif f not in plus and f not in minus:
                plain[f] = None
    for found, weight in ((plus, PLUS), (minus, MINUS), (plain, PLAIN)):
        for f in found:
            out.weights.setdefault(f, weight)
    return out


def _pieces(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts in parts of about PIECE bytes."""
    at, size = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if size and size + n > PIECE:
            yield texts[at:i].to_pylist()
            at, size = i, 0
        size += n
    yield texts[at:].to_pylist()


def tokens(stopwords: frozenset[str]):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, tuple[str, ...]] = {}  # words repeat

        def of(text: str | None) -> list[str]:
            found: set[str] = set()
            for word in set((text or "").split()):
                forms = known.get(word)
                if forms is None:
                    if len(known) >= KNOWN:
                        known.clear()
                    forms = known[word] = tuple(W.word_forms(word, stopwords))
                found.update(forms)
            return sorted(found - stopwords)

        for texts in batches:
            for piece in _pieces(texts):
                yield pa.array([of(text) for text in piece], pa.list_(pa.string()))

    return F.arrow_udf(run, T.ArrayType(T.StringType()))


def indexed(df: DataFrame, attr: str, stopwords: frozenset[str], name: str = "_wf_tokens") -> DataFrame:
    return df.withColumn(name, tokens(stopwords)(F.col(f"`{attr}`").cast("string")))


def search(df: DataFrame, query: Query, order: list, score: str, words: str | None, limit: int | None, min_score: float | None, tokens_at: str = "_wf_tokens") -> DataFrame:
    """Matching rows with their score. Each row is judged by its own words, so nothing is shuffled but the top of the result."""
    terms = list(query.weights)
    have = F.col(tokens_at)
    if not terms:
        out = df.where(F.lit(False)).withColumns({score: F.lit(0).cast("bigint"), "_wf_first": F.lit(0)})
    else:
        listed = F.array(*[F.lit(t) for t in terms])
        value = F.create_map(*[x for t, w in query.weights.items() for x in (F.lit(t), F.lit(w).cast("bigint"))])
        met = F.filter(listed, lambda t: F.array_contains(have, t))
        out = df.withColumn("_wf_met", met).where(F.size("_wf_met") > 0)
        for group in query.required:
            out = out.where(F.arrays_overlap(have, F.array(*[F.lit(g) for g in group])) if group else F.lit(False))
        if query.excluded:
            out = out.where(~F.arrays_overlap(have, F.array(*[F.lit(x) for x in sorted(query.excluded)])))
        out = out.withColumns({score: F.aggregate("_wf_met", F.lit(0).cast("bigint"), lambda a, t: a + value[t]), "_wf_first": F.array_position(listed, F.col("_wf_met")[0]).cast("int")}).drop("_wf_met")
    if limit is not None:
        out = out.orderBy(F.desc(score), "_wf_first", *order_columns(order)).limit(int(limit))
    if min_score is not None:
        out = out.where(F.col(score) >= min_score)
    if words:
        out = out.withColumn(words, F.array_sort(have))
    return out.drop(tokens_at)


def stopwords_of(given: Iterable[str] | None) -> frozenset[str]:
    return W.STOPWORDS if given is None else frozenset(given)


__all__ = ["Iterator", "Query", "indexed", "parse", "search", "stopwords_of"]
