"""Keyword-stuffed and link-list pages, told by suffix automata and missing clauses.

Each page's suffix automaton over its words gives the characters covered by repeated substrings. What ties
clauses together is learned from a bounded sample of hand-labelled pages: words that stand in sentences of
ordinary pages and hardly in spam. With these figures and those of links and marks a classifier, trained on the
same sample, decides. All pages are judged, each by itself and whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm.boost import Blend
from lamina.llm.pages import FEATURES, clause_candidates, figures
from lamina.session import cut

#: Labelled pages that a model is trained on at most; of more, those with the smallest hash are taken.
LABELS = 20_000
#: Log odds above which a page is spam. Below even, as the classifier rarely accuses wrongly and misses more.
THRESHOLD = -0.5


#: Words that tie clauses, at most; of more, those that occur on the most ordinary pages are taken.
TIES = 4096
#: A tie occurs on this share of the ordinary pages, on three at least, and so many times as often as on spam.
TIE_SHARE, TIE_RATIO = 0.005, 2.0


@dataclass(frozen=True)
class Model:
    """What is learned from labelled pages."""

    ties: frozenset[str]
    blend: Blend


def page_figures(text: Column, ties: frozenset[str]) -> Column:
    """figures() of each text; null for null texts and pages that say nothing."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def each(texts: pa.Array) -> pa.Array:
        return pa.array([figures(t, ties) for t in texts.to_pylist()], pa.list_(pa.float64()))

    return each(text)


@F.arrow_udf(T.ArrayType(T.StringType()))
def page_words(texts: pa.Array) -> pa.Array:
    """Distinct words of each page that stand in lines long enough to be clauses."""
    return pa.array([sorted(clause_candidates(t)) for t in texts.to_pylist()], pa.list_(pa.string()))


def sample(labels: DataFrame, limit: int = LABELS) -> DataFrame:
    """(doc_id, spam): one label per document (the latest of several), at most ``limit``, the same in every run."""
    known = labels.where(F.col("label").isin("spam", "ok") & F.col("doc_id").isNotNull())
    last = known.groupBy("doc_id").agg(F.max_by("label", F.struct("labelled_at", "label")).alias("label"))
    return last.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).select("doc_id", (F.col("label") == "spam").alias("spam"))


def learn_ties(marked: DataFrame) -> frozenset[str]:
    """Words that tie clauses, from labelled pages (text, spam). At most TIES of them reach the driver."""
    n = marked.agg(F.count(F.when(~F.col("spam"), 1)).alias("ok"), F.count(F.when(F.col("spam"), 1)).alias("bad")).first()
    words = marked.select("spam", F.explode(page_words("text")).alias("word")).groupBy("word").agg(F.count(F.when(~F.col("spam"), 1)).alias("ok"), F.count(F.when(F.col("spam"), 1)).alias("bad"))
    often = F.col("ok") >= max(3.0, TIE_SHARE * n["ok"])
    apart = (F.col("ok") + 1) / (n["ok"] + 2) >= TIE_RATIO * (F.col("bad") + 1) / (n["bad"] + 2)
    return frozenset(r["word"] for r in words.where(often & apart).orderBy(F.desc("ok"), "word").limit(TIES).select("word").collect())


def train(documents: DataFrame, labels: DataFrame, limit: int = LABELS) -> Model:
    """A model fitted on the labelled sample. Bounded: ``limit`` rows of figures and TIES words reach the driver.

    Without any label the model calls nothing spam.
    """
    chosen = F.broadcast(sample(labels, limit))  # at most ``limit`` rows of two small columns
    marked = cut(documents.select("doc_id", "text").join(chosen, "doc_id").where("text IS NOT NULL").select("doc_id", "text", "spam"))  # read twice, found in all documents
    ties = learn_ties(marked)
    rows = marked.select("doc_id", "spam", page_figures(F.col("text"), ties).alias("x")).toPandas()
    rows = rows[rows["x"].notna()]
    blend = Blend()
    if rows.empty:
        blend.trees.base = -np.inf
    else:
        rows = rows.sort_values(["doc_id", "spam"], kind="stable")
        blend.fit(np.stack(rows["x"].to_numpy()), rows["spam"].to_numpy(dtype=float))
    return Model(ties, blend)


def score(text: Column, model: Model) -> Column:
    """Log odds that a page is spam; null for null texts and pages that say nothing."""

    @F.arrow_udf(T.DoubleType())
    def odds(texts: pa.Array) -> pa.Array:
        found = [figures(t, model.ties) for t in texts.to_pylist()]
        said = [x for x in found if x is not None]
        scores = iter(model.blend.score(np.array(said)).tolist() if said else ())
        return pa.array([None if x is None else next(scores) for x in found], pa.float64())

    return odds(text)


def scored(documents: DataFrame, labels: DataFrame, limit: int = LABELS) -> DataFrame:
    """(doc_id, odds) of every document."""
    return documents.select("doc_id", score(F.col("text"), train(documents, labels, limit)).alias("odds"))


def found(documents: DataFrame, labels: DataFrame, limit: int = LABELS) -> DataFrame:
    """doc_id of spam pages. Null, empty and blank texts and pages without message and added lines are none.

    Copies are judged alike, each in its own row. Two narrow passes over the texts; nothing is shuffled but the labels.
    """
    return scored(documents, labels, limit).where(F.col("odds") > THRESHOLD).select("doc_id")


def explained(documents: DataFrame, labels: DataFrame, limit: int = LABELS) -> DataFrame:
    """(doc_id and one column per figure) of every document that says something."""
    ties = train(documents, labels, limit).ties
    x = documents.select("doc_id", page_figures(F.col("text"), ties).alias("x")).where("x IS NOT NULL")
    return x.select("doc_id", *[F.col("x")[i].alias(name) for i, name in enumerate(FEATURES)])
