"""The gates: input, retrieval, citations, grounding; and the extractive answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import constants as K
from quillon.functions import text as T


def has_question(q: Column) -> Column:
    """A question mark or word; for other scripts the words of the first script the text has."""
    other = F.lit(False)
    for chars, words in reversed(K.QUESTION_BY_SCRIPT):
        other = F.when(q.rlike(f"[{chars}]"), q.rlike(words)).otherwise(other)
    return q.rlike(K.QUESTION) | other


def input_gate(c: Column | str) -> Column:
    """The reason to refuse a question, or null to let it pass; the first rule that fits wins."""
    q = T.strip(F.coalesce(T.col(c), F.lit("")))
    compact = F.regexp_replace(q, r"\s+", "")
    out = F.when(q == "", "EMPTY").when(F.length(q) < 3, "TOO_SHORT").when(q.rlike(K.SELF_HARM), "UNSAFE")
    for p in K.UNSAFE:
        out = out.when(q.rlike(p), "UNSAFE")
    for p in K.INJECTION:
        out = out.when(q.rlike(p), "INJECTION")
    # 2**1.8 distinct characters can't be reached by three, and four or more in a long text seldom fall short
    out = out.when((F.length(compact) >= 6) & (T.char_entropy(compact) < 1.8), "GIBBERISH")
    out = out.when(~q.rlike(r"\p{L}"), "GIBBERISH")
    return out.when(q.rlike(K.IMPERATIVE) & (F.size(F.split(q, r"\s+")) > 6) & ~has_question(q), "NOT_A_QUESTION")


def retrieval_gate(top: Column, agreement: Column, overlap: Column, min_top: float = 0.80, min_agreement: int = 2, rescue_score: float = 0.20, rescue_overlap: float = 0.5) -> Column:
    """LOW_CONFIDENCE, NO_AGREEMENT, or null to let the hit pass."""
    rescued = (top >= rescue_score) & (overlap >= rescue_overlap)
    return F.when((top < min_top) & ~rescued, "LOW_CONFIDENCE").when((agreement < min_agreement) & (overlap < 0.15), "NO_AGREEMENT")


def needs_support(c: Column | str) -> Column:
    """Whether a refused question speaks of self-harm: it gets words of support and where to turn, never a plain refusal."""
    return T.strip(F.coalesce(T.col(c), F.lit(""))).rlike(K.SELF_HARM)


def chosen_gate(top: Column, agreement: Column, overlap: Column, rescored: Column, of_user: Column, **fitted) -> Column:
    """The retrieval gate with the thresholds that a hit calls for: no score test where hits were not rescored, no rescue for
    hits of the corpus, all of it for a user's own. ``fitted`` thresholds replace the defaults."""
    no_score = retrieval_gate(top, agreement, overlap, **{**fitted, "min_top": float("-inf")})
    no_rescue = retrieval_gate(top, agreement, overlap, **{**fitted, "rescue_score": float("inf")})
    return F.when(~rescored, no_score).when(~of_user, no_rescue).otherwise(retrieval_gate(top, agreement, overlap, **fitted))


def citation_gate(cited: Column, available: Column) -> Column:
    """FABRICATED_CITATION if a citation is no whole number from 1 to ``available``; an empty list passes."""
    return F.when(F.exists(cited, lambda n: (n != F.floor(n)) | (n < 1) | (n > available)), "FABRICATED_CITATION")


def context_tokens(contexts: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(contexts, T.content_set)))


def grounding_score(answer: Column, contexts: Column) -> Column:
    return T.overlap(T.content_set(answer), context_tokens(contexts))


def grounding_gate(answer: Column, contexts: Column, min_coverage: float = 0.34) -> Column:
    """UNGROUNDED or null. Every number and name must be in the contexts; across scripts only numbers are looked at."""
    joined = F.array_join(contexts, " ")
    a, b = T.dominant_script(answer), T.dominant_script(joined)
    across = (a != b) & (a != "unknown") & (b != "unknown")
    flat = F.regexp_replace(F.lower(T.normalise_digits(joined)), r"[^\p{L}\p{N}\p{M}\s]", " ")
    known = F.split(flat, r"\s+")
    found = T.specifics(T.normalise_digits(answer))
    checked = F.when(across, F.filter(found, lambda w: w.rlike(r"\d"))).otherwise(found)
    invented = F.size(F.array_except(checked, known)) > 0
    return F.when(invented, "UNGROUNDED").when(~across & (grounding_score(answer, contexts) < min_coverage), "UNGROUNDED")


def grounded_sentences(answer: Column, contexts: Column, least: float = 0.55) -> Column:
    return F.array_join(F.filter(T.sentences(answer), lambda s: grounding_score(s, contexts) >= least), " ")


def verify_generated(answer: Column, contexts: Column, cited: Column) -> Column:
    """Citations first; then grounding in the cited contexts only, in all if none is cited."""
    chosen = F.when(F.size(cited) > 0, F.transform(cited, lambda n: F.try_element_at(contexts, n.cast("int")))).otherwise(contexts)
    return F.coalesce(citation_gate(cited, F.size(contexts)), grounding_gate(answer, F.filter(chosen, lambda x: x.isNotNull())))


def extract_answer(query: Column, passage: Column, most: int = 2) -> Column:
    """The ``most`` sentences that share most of the query's words, in their own order; the passage if it has no more."""
    parts = T.sentences(passage)
    asked = T.content_set(query)
    scored = F.transform(parts, lambda s, i: F.struct((-T.overlap(asked, T.content_set(s))).alias("s"), i.alias("i"), s.alias("t")))
    best = F.transform(F.slice(F.array_sort(scored), 1, most), lambda x: F.struct(x["i"].alias("i"), x["t"].alias("t")))
    picked = F.array_join(F.transform(F.array_sort(best), lambda x: x["t"]), " ")
    return F.when(F.size(parts) <= most, T.strip(passage)).otherwise(picked)
