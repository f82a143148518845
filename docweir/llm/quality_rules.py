"""Quality rules by weak supervision.

Every rule votes good or bad on a document or abstains. How often each rule gives each vote on good
and on bad documents is estimated by expectation-maximisation (Dawid and Skene), from nothing but
the votes; the posterior probability of good replaces the demand that a document pass all rules. Agreement
is what tells a good rule from a noisy one; a rule that sees a kind of its own counts alone if it alarms rarely.

The votes of a corpus are counted by pattern, of which there are at most 3 ** len(RULES), so what
reaches the driver has a fixed bound. Counts cover all documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, durable, enter
from .textvec import SPACE, by_doc, mix, ngrams, pieces

#: The share of lone alarms at which a rule is as likely to be wrong as right; how much of a kind a sharp rule sees.
ALONE, SHARP = 1 / 3, 0.9
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What the rules read besides the measures of the contract.
MORE = ["n_lines", "n_upper", "n_letters", "n_bars", "n_shouts", "n_stops", "n_beyond", "n_distinct"]

_FLAGS = {c: np.isin(np.arange(256), list(s)) for c, s in {"n_symbols": b"#*$%&|<>", "n_bars": b"|", "n_shouts": b"!", "n_stops": b".?"}.items()}
_UPPER = np.isin(np.arange(256), list(range(65, 91)))
_LETTER = _UPPER | np.isin(np.arange(256), list(range(97, 123)))


def measure(batch: pa.RecordBatch, name: str = "text") -> dict[str, np.ndarray]:
    """The measures of each row's whole text; a null counts as an empty text."""
    out = {c: np.zeros(batch.num_rows, np.int64) for c in [*MEASURES, *MORE]}
    for i, j, t in pieces(batch, name):
        n = j - i
        doc, s, e = t.words()
        word = t.hashes(s, e)
        put = lambda c, v: out[c].__setitem__(slice(i, j), v)
        put("n_words", np.bincount(doc, minlength=n))
        put("word_chars", t.total(~SPACE[t.buf] & ((t.buf & 0xC0) != 0x80)))
        for c, flags in _FLAGS.items():
            put(c, t.total(flags[t.buf]))
        put("n_upper", t.total(_UPPER[t.buf]))
        put("n_letters", t.total(_LETTER[t.buf]))
        put("n_beyond", t.total(t.buf >= 0xC0))  # code points beyond ASCII
        put("n_distinct", np.bincount(doc[np.unique(by_doc(doc, word), return_index=True)[1]], minlength=n))
        ld, ls, le = t.lines()
        full = np.zeros(len(ls), bool)
        full[np.searchsorted(ls, s, "right") - 1] = True
        ld, ls, le = ld[full], ls[full], le[full]
        lines = np.bincount(ld, minlength=n)
        _, first = np.unique(by_doc(ld, t.hashes(ls, le)), return_index=True)
        put("n_lines", lines)
        put("n_dup_lines", lines - np.bincount(ld[first], minlength=n))
        put("n_repeat_words", _repeated(doc, word, n))
    return out


def _repeated(doc: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    """Words in runs of three that the document has twice or more."""
    if len(word) < 3:
        return np.zeros(n, np.int64)
    at = np.flatnonzero(doc[:-2] == doc[2:])
    d, h = ngrams(doc, word, 3, n, short=False)
    key = by_doc(d, h)
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    hit = np.zeros(len(word), bool)
    for k in range(3):
        hit[at[again] + k] = True
    return np.bincount(doc[hit], minlength=n)


def _three(value: Column, bad: Column, good: Column) -> Column:
    return F.when(value.isNull(), 1).when(bad, 0).when(good, 2).otherwise(1)


def rules() -> dict[str, Column]:
    """Each rule's vote: 0 bad, 1 abstains, 2 good. Texts without a word get no good vote."""
    words = F.when(F.col("n_words") > 0, F.col("n_words"))
    share = lambda c, of=words: F.col(c) / of
    length = F.col("word_chars") / words
    letters = F.when(F.col("n_letters") > 20, F.col("n_letters"))
    lines = F.when(F.col("n_lines") > 3, F.col("n_lines"))
    alpha = (F.col("n_letters") + F.col("n_beyond")) / F.when(F.col("n_words") > 0, F.col("word_chars"))
    variety = F.when(words >= 50, F.col("n_distinct") / F.sqrt(words))
    return {
        "symbols": _three(share("n_symbols"), share("n_symbols") > 0.3, share("n_symbols") < 0.1),
        "repeats": _three(share("n_repeat_words"), share("n_repeat_words") > 0.4, share("n_repeat_words") < 0.3),
        "capitals": _three(share("n_upper", letters), share("n_upper", letters) > 0.5, share("n_upper", letters) < 0.3),
        "lines": _three(share("n_dup_lines", lines), share("n_dup_lines", lines) > 0.5, share("n_dup_lines", lines) < 0.3),
        "length": _three(length, (length > 15) | (length < 2.5), length.between(3, 12)),
        "shouts": _three(share("n_shouts"), share("n_shouts") > 0.2, share("n_shouts") < 0.05),
        "bars": _three(share("n_bars"), share("n_bars") > 0.2, share("n_bars") < 0.05),
        "stops": _three(words, (words >= 100) & (share("n_stops") < 0.002), share("n_stops") >= 0.005),
        "words": _three(F.col("n_words"), F.col("n_words") < 20, F.col("n_words") >= 50),
        "letters": _three(alpha, alpha < 0.75, alpha >= 0.8),
        "variety": _three(variety, variety < 4, variety >= 5),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def pattern() -> Column:
    """The votes as one number in base 3."""
    return sum((v * 3**i for i, v in enumerate(rules().values())), F.lit(0)).cast("int")


def _fit(votes: np.ndarray, n: np.ndarray, share: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, float, np.ndarray]:
    """(share, log likelihood, table) after expectation-maximisation from share (patterns x classes).
    table: class x rule x vote. A Beta (Dirichlet) prior of half a document a vote keeps all of them positive."""
    n_rules, last = votes.shape[1], -np.inf
    hot = (votes[:, :, None] == np.arange(3)).astype(float).reshape(len(votes), -1)
    for _ in range(rounds):
        part = share * n[:, None]
        prior = (part.sum(0) + 1) / (n.sum() + share.shape[1])
        table = (part.T @ hot).reshape(-1, n_rules, 3) + 0.5
        table /= table.sum(2, keepdims=True)
        log = np.log(prior)[None] + hot @ np.log(table).reshape(len(table), -1).T
        most = log.max(1, keepdims=True)
        share = np.exp(log - most)
        total = share.sum(1, keepdims=True)
        share /= total
        fit = float(n @ (most + np.log(total))[:, 0])
        if fit - last <= 1e-9 * abs(fit):
            break
        last = fit
    return share, fit, table


def estimate(counts: dict[int, int], n_rules: int) -> dict[int, float]:
    """The posterior probability of good for each pattern of votes, by expectation-maximisation.

    Each class of documents gives each rule's votes independently, at rates that are estimated from the
    votes of all documents; none is given or held. Bad documents differ in kind (one is all capitals,
    another all symbols), so there may be several bad classes. The fit starts with one for each rule,
    holding what the rule calls bad, and drops classes as long as Akaike's information criterion gets
    better. Classes that expect a bad vote or more are bad: rules agree there. What a rule's own vote is worth
    is seen by how often it is right where others agree, so a rule that cries wolf is outvoted.

    Lone bad votes among what the classes call good may be a kind of document that just one rule sees. They
    are taken for that if the rule gives them clearly more often than the median rule (random alarms come from
    all rules), and is not known to be loose: it has a bad vote for SHARP of the documents of a bad class, or no
    class has to do with it. Nothing but their rate tells how far to trust them: with a share a of the good
    classes' documents, they stay good with probability a / (a + ALONE). So few alarms count alone, and a rule
    that calls more than ALONE of all else bad is noise. No pattern gives no posterior.
    """
    if not counts:
        return {}
    keys = sorted(counts)
    votes = np.array([[k // 3**i % 3 for i in range(n_rules)] for k in keys])
    n = np.array([counts[k] for k in keys], float)
    bad = votes == 0
    share = np.where(bad.any(1)[:, None], 0.95 * bad / np.maximum(bad.sum(1), 1)[:, None], 0.05 / n_rules)[:, (n @ bad) > 0]
    share = np.concatenate([1 - share.sum(1, keepdims=True), share], 1)  # patterns x classes
    cost = lambda classes: classes * (2 * n_rules + 1)
    share, fit, table = _fit(votes, n, share)
    score = fit - cost(share.shape[1])
    while share.shape[1] > 1:
        fits = []
        for k in range(share.shape[1]):
            rest = np.delete(share, k, 1) + 1e-6
            fits.append(_fit(votes, n, rest / rest.sum(1, keepdims=True), 60))
        best = max(range(len(fits)), key=lambda k: fits[k][1])
        if fits[best][1] - cost(len(fits) - 1) < score:
            break
        share, fit, table = fits[best]
        score = fit - cost(share.shape[1])
    share, _, table = _fit(votes, n, share)
    good = table[:, :, 0].sum(1) < 1
    p = share[:, good].sum(1)
    lone = (p * n) @ bad / max(float(p @ n), 1e-9)  # of each rule, among what the classes call good
    caught = table[~good, :, 0].max(0) if (~good).any() else np.zeros(n_rules)
    own_kind = (lone > 3 * np.median(lone)) & ((caught >= SHARP) | (caught <= np.maximum(2 * lone, 0.1)))
    p *= np.where(bad & own_kind, lone / (lone + ALONE), 1).prod(1)
    return {k: float(g) for k, g in zip(keys, p, strict=True)}


def posterior(spark: SparkSession, by_pattern: DataFrame) -> DataFrame:
    """pattern and p_good of each pattern of by_pattern (pattern, n), 3 ** len(RULES) rows at most."""
    est = estimate({r[0]: r[1] for r in by_pattern.collect()}, len(rules()))
    return F.broadcast(spark.createDataFrame(sorted(est.items()), "pattern int, p_good double"))


def _measured(batch: pa.RecordBatch, key: str) -> pa.RecordBatch:
    m = measure(batch)
    return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(m[c]) for c in [*MEASURES, *MORE])], [key, *MEASURES, *MORE])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of each row of docs; a null text counts as empty, repeated rows get a row
    each, no rows give none."""
    return arrow_map(docs, ["doc_id", "text"], lambda b: _measured(b, "doc_id"), "doc_id long, " + ", ".join(f"{c} long" for c in [*MEASURES, *MORE]))


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the measures, pattern, p_good, base_failed and kept of each row of docs.

    A null or empty text has measures of 0 and fails; repeated rows and rows with a null doc_id get
    a row each; other columns don't matter; no rows give none.
    """
    m = durable(measured(docs).withColumn("pattern", pattern()), "measures")
    p = posterior(docs.sparkSession, m.groupBy("pattern").agg(F.count("*").alias("n")))
    return m.join(p, "pattern").withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns.

    Texts are measured twice, once to count the votes and once to filter, so that no text is
    shuffled and rows need no key. Null and empty texts go, repeated rows and null ids are judged each; no
    rows give none.
    """
    names = [*MEASURES, *MORE]
    votes = measured(docs).groupBy(pattern().alias("pattern")).agg(F.count("*").alias("n"))
    p = posterior(docs.sparkSession, votes)

    @F.arrow_udf("struct<" + ", ".join(f"{c}: bigint" for c in names) + ">")
    def measures(text: pa.Array) -> pa.Array:
        enter("quality")
        m = measure(pa.RecordBatch.from_arrays([text], ["text"]))
        return pa.StructArray.from_arrays([pa.array(m[c]) for c in names], names)

    flat = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_docweir_row"), measures(F.col("text")).alias("_docweir_m"))
    flat = flat.select("_docweir_row", *[F.col("_docweir_m")[c].alias(c) for c in names])
    kept = flat.withColumn("pattern", pattern()).where(~base_failed()).join(p.where(F.col("p_good") >= threshold), "pattern", "left_semi")
    return kept.select(*[F.col("_docweir_row")[c].alias(c) for c in docs.columns])


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs).select("doc_id", *MEASURES, "p_good", "base_failed", "kept")
