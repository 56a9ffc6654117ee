"""Quality rules as weak supervision.

Each rule votes good (1), bad (-1) or abstains (0) on whole-text counts.  The
counts of the vote patterns over all documents, at most 3^rules rows, go to
expectation-maximisation, which estimates each rule's accuracy and the share
of good documents.  The verdict is the posterior probability of *good*: a
rule's vote counts as much as its estimated accuracy, and rules that find
ordinary prose can outvote a doubtful one.  An initial opinion about the
accuracies counts half as much as the documents do; neither they nor the share
are bounded.  DataFrame functions only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

#: Fixed values of the contract: white space that separates words, and counted symbols.
SPACE = r"\x20\x09-\x0D"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8

#: Counts that :func:`word_stats` adds.
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaim", "n_pipes", "n_plain", "n_distinct")
#: A word of letters, with punctuation after it at most.
PLAIN_WORD = r"\p{L}+[.,;:!?]*"


@dataclass(frozen=True)
class Rule:
    """``good`` and ``bad`` are SQL predicates over the counts, valid in Spark and DuckDB alike."""

    name: str
    good: str
    bad: str


#: Different words against all words, alike for short and long texts: they grow with the square root of the words or faster.
_VARIED = "n_distinct * n_distinct >= 12 * n_words"
#: Most rules know one kind of junk and abstain elsewhere; ``symbols``, ``variety`` and ``prose`` know ordinary prose too.
RULES: tuple[Rule, ...] = (
    Rule("symbols", "100 * n_symbols <= 5 * n_words AND 100 * n_exclaim <= 10 * n_words AND 100 * n_upper <= 20 * word_chars", "100 * n_symbols > 25 * n_words"),
    Rule("tables", "false", "100 * n_pipes > 15 * n_words"),
    Rule("plain_words", "false", "100 * n_plain < 75 * n_words"),
    Rule("word_length", "false", "word_chars < 2 * n_words OR word_chars > 13 * n_words"),
    Rule("capitals", "false", "100 * n_upper > 40 * word_chars"),
    Rule("exclaims", "false", "100 * n_exclaim > 40 * n_words"),
    Rule("dup_lines", "false", "100 * n_dup_lines > 30 * n_lines"),
    Rule("repeats", "false", "100 * n_repeat_words > 20 * n_words"),
    Rule("monotony", "false", "n_distinct * n_distinct < 8 * n_words"),
    Rule("variety", f"{_VARIED} AND 100 * n_repeat_words <= 5 * n_words AND 100 * n_dup_lines <= 10 * n_lines AND 100 * n_exclaim <= 20 * n_words", "n_distinct * n_distinct < 2 * n_words"),
    Rule("prose", f"100 * n_plain >= 85 * n_words AND word_chars BETWEEN 3 * n_words AND 10 * n_words AND {_VARIED} AND 100 * n_exclaim <= 20 * n_words", "100 * n_plain < 40 * n_words"),
)
BASE_FAILED = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"
ROUNDS = 12
#: Where expectation-maximisation starts, and how many imagined documents or votes that opinion counts as.
START_ACCURACY, ACCURACY_VOTES = 0.85, 200.0
START_SHARE, SHARE_VOTES = 0.7, 20.0


def word_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` without the text, and the counts of :data:`STATS` (long) of the whole text.

    ``n_repeat_words`` counts the words in windows of eight words found twice
    or more.  Hashes only find the documents that can have such windows; there
    the windows themselves are compared.  Null text has no words.  Columns of
    the input with the names of counts are replaced; other names don't matter.
    """
    kept = [c for c in docs.columns if c != text and c not in STATS]
    keep = ["_kept"]
    base = docs.select(F.struct(F.lit(0).alias("_"), *(F.col(c) for c in kept)).alias("_kept"), text_or_empty(text).alias("_text"))
    split = base.select(
        *keep,
        F.length("_text").alias("_chars"),
        F.split(F.btrim("_text", F.lit(" \t\n\x0b\x0c\r")), f"[{SPACE}]+").alias("_words"),
        F.expr(rf"filter(split(_text, '\n'), l -> l rlike '[^{SPACE}]')".replace("\\x", "\\\\x").replace("\\n", "\\n")).alias("_lines"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("_text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("_text", F.lit("!")).cast("long").alias("n_exclaim"),
        F.regexp_count("_text", F.lit(r"\|")).cast("long").alias("n_pipes"),
        F.regexp_count("_text", F.lit(rf"(?<![^{SPACE}]){PLAIN_WORD}+(?![^{SPACE}])")).cast("long").alias("n_plain"),
    )
    window = ", ".join(f"_words[i + {k}]" for k in range(WINDOW))
    counted = split.withColumn("n_words", F.expr("CASE WHEN _words[0] = '' THEN 0L ELSE cast(size(_words) as long) END")).withColumn(
        "_hashes", F.expr(f"CASE WHEN n_words > {WINDOW} THEN transform(sequence(0, size(_words) - {WINDOW}), i -> xxhash64({window})) END")
    )
    flagged = counted.select(
        *keep,
        "_words",
        "n_words",
        F.expr("cast(length(array_join(_words, '')) as long)").alias("word_chars"),
        "n_symbols",
        F.expr("cast(size(_lines) - size(array_distinct(_lines)) as long)").alias("n_dup_lines"),
        F.expr("cast(size(_lines) as long)").alias("n_lines"),
        "n_upper",
        "n_exclaim",
        "n_pipes",
        "n_plain",
        F.expr("CASE WHEN n_words = 0 THEN 0L ELSE cast(size(array_distinct(_words)) as long) END").alias("n_distinct"),
        F.expr("coalesce(size(array_distinct(_hashes)) < size(_hashes), false)").alias("_twice"),
    )
    ordered = flagged.withColumn(
        "_sorted", F.expr(f"CASE WHEN _twice THEN sort_array(transform(sequence(0, size(_words) - {WINDOW}), i -> struct(concat_ws(' ', {window}) AS w, i AS i))) END")
    ).drop("_words")
    starts = ordered.withColumn(
        "_starts",
        F.expr(
            "CASE WHEN _twice THEN sort_array(transform(filter(sequence(0, size(_sorted) - 1), k ->"
            " (k > 0 AND _sorted[k].w = _sorted[greatest(k - 1, 0)].w) OR (k < size(_sorted) - 1 AND _sorted[k].w = _sorted[least(k + 1, size(_sorted) - 1)].w)),"
            " k -> _sorted[k].i)) END"
        ),
    ).drop("_sorted")
    repeat = f"""CASE WHEN coalesce(size(_starts), 0) > 0 THEN cast({WINDOW} + CASE WHEN size(_starts) > 1 THEN
        aggregate(sequence(1, size(_starts) - 1), 0, (a, k) -> a + least({WINDOW}, _starts[k] - _starts[k - 1])) ELSE 0 END as long) ELSE 0L END"""
    counts = (F.expr(repeat).alias(c) if c == "n_repeat_words" else F.col(c) for c in STATS)
    return starts.select(*(F.col("_kept").getField(c).alias(c) for c in kept), *counts)


def votes(rules: Sequence[Rule] = RULES) -> list[Column]:
    return [F.expr(f"CASE WHEN {r.good} THEN 1 WHEN {r.bad} THEN -1 ELSE 0 END").alias(f"vote_{r.name}") for r in rules]


@dataclass(frozen=True)
class LabelModel:
    """Share of good documents and accuracy of each rule."""

    share: float
    accuracy: tuple[float, ...]

    def posterior(self, vote_columns: Sequence[str]) -> Column:
        """Probability of *good* given the votes."""
        logit = F.lit(math.log(self.share / (1 - self.share)))
        for name, a in zip(vote_columns, self.accuracy, strict=True):
            logit = logit + F.col(name) * F.lit(math.log(a / (1 - a)))
        return 1 / (1 + F.exp(-logit))


def fit_label_model(patterns: Sequence[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = ROUNDS) -> LabelModel:
    """Expectation-maximisation over (votes, number of documents) pairs.

    The starting opinion counts as some documents and votes, so few or uniform
    documents leave the rules near where they started.
    """
    share, accuracy = START_SHARE, [START_ACCURACY] * n_rules
    for _ in range(rounds):
        good = total = 0.0
        right, cast = [0.0] * n_rules, [0.0] * n_rules
        for vote, n in patterns:
            logit = math.log(share / (1 - share)) + sum(v * math.log(a / (1 - a)) for v, a in zip(vote, accuracy, strict=True))
            p = 1 / (1 + math.exp(-logit))
            good, total = good + n * p, total + n
            for j, v in enumerate(vote):
                if v:
                    right[j] += n * (p if v > 0 else 1 - p)
                    cast[j] += n
        share = (good + START_SHARE * SHARE_VOTES) / (total + SHARE_VOTES)
        accuracy = [(r + START_ACCURACY * ACCURACY_VOTES) / (c + ACCURACY_VOTES) for r, c in zip(right, cast, strict=True)]
    return LabelModel(share, tuple(accuracy))


def judge(docs: DataFrame, *, text: str = "text", rules: Sequence[Rule] = RULES, threshold: float = 0.5) -> DataFrame:
    """Columns of ``docs`` without the text, the counts, ``base_failed``, ``quality_posterior`` and ``kept``.

    An empty table gives an empty result; null or empty text fails the base
    rules; repeated rows are judged alike; columns of the input with the names
    of results are replaced.
    """
    names = [f"vote_{r.name}" for r in rules]
    results = {*STATS, *names, "base_failed", "quality_posterior", "kept"}
    stats = materialize(word_stats(docs.select(*(c for c in docs.columns if c not in results or c == text)), text), "word-stats")
    keep = stats.columns
    voted = stats.select(*keep, *votes(rules))
    patterns = voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3^rules rows
    model = fit_label_model(sorted((tuple(r[c] for c in names), r["n"]) for r in patterns), len(rules))
    return voted.select(*keep, F.expr(BASE_FAILED).alias("base_failed"), model.posterior(names).alias("quality_posterior")).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality_posterior") >= threshold)
    )


def accept(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is kept, with all their columns.

    A row is carried whole beside the counts of its text, so nothing is joined
    and keys don't matter.  Equal texts get equal verdicts and repeated rows
    stay repeated; null and empty texts go; columns of any name pass
    unchanged; an empty table gives an empty result.
    """
    rows = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("_row"), F.col(text).alias("_body"))
    return judge(rows, text="_body").filter("kept").select("_row.*")


def oracle_sql(rules: Sequence[Rule] = RULES, rounds: int = ROUNDS) -> str:
    """DuckDB SQL for the query over ``documents``."""
    n = len(rules)
    vote = ", ".join(f"CASE WHEN {r.good} THEN 1 WHEN {r.bad} THEN -1 ELSE 0 END AS v{j}" for j, r in enumerate(rules))
    parts = [
        rf"""w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+') AS words,
            list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^{SPACE}]')) AS lines FROM documents)""",
        f"""x AS (SELECT doc_id, unnest(range(0, len(words) - {WINDOW - 1})) AS i, words FROM w WHERE len(words) > {WINDOW}),
        y AS (SELECT doc_id, i, array_to_string(words[i + 1 : i + {WINDOW}], ' ') AS s FROM x),
        z AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM y),
        q AS (SELECT doc_id, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, {WINDOW})) AS g FROM z WHERE c > 1),
        rep AS (SELECT doc_id, sum(g)::BIGINT AS n_repeat_words FROM q GROUP BY doc_id)""",
        f"""s AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
            (length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')))::BIGINT AS n_symbols,
            (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines,
            (length(t) - length(regexp_replace(t, '\\p{{Lu}}', '', 'g')))::BIGINT AS n_upper, (length(t) - length(replace(t, '!', '')))::BIGINT AS n_exclaim, (length(t) - length(replace(t, '|', '')))::BIGINT AS n_pipes,
            len(list_filter(words, lambda x: regexp_full_match(x, '{PLAIN_WORD}')))::BIGINT AS n_plain,
            len(list_distinct(words))::BIGINT AS n_distinct, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
            FROM w LEFT JOIN rep USING (doc_id))""".replace("\\\\p", "\\p"),
        f"v AS (SELECT *, {vote} FROM s)",
        f"p AS (SELECT {', '.join(f'v{j}' for j in range(n))}, count(*) AS n FROM v GROUP BY ALL)",
        f"m0 AS (SELECT {START_SHARE!r}::DOUBLE AS share, {', '.join(f'{START_ACCURACY!r}::DOUBLE AS a{j}' for j in range(n))})",
    ]
    posterior = "1 / (1 + exp(-(ln(share / (1 - share)) + " + " + ".join(f"v{j} * ln(a{j} / (1 - a{j}))" for j in range(n)) + ")))"
    for k in range(rounds):
        share = f"(coalesce(sum(n * p), 0) + {START_SHARE * SHARE_VOTES!r}) / (coalesce(sum(n), 0) + {SHARE_VOTES!r})"
        right = [f"coalesce(sum(CASE v{j} WHEN 1 THEN n * p WHEN -1 THEN n * (1 - p) ELSE 0 END), 0)" for j in range(n)]
        cast = [f"coalesce(sum(CASE WHEN v{j} <> 0 THEN n ELSE 0 END), 0)" for j in range(n)]
        accuracy = ", ".join(f"({r} + {START_ACCURACY * ACCURACY_VOTES!r}) / ({c} + {ACCURACY_VOTES!r}) AS a{j}" for j, (r, c) in enumerate(zip(right, cast, strict=True)))
        parts.append(f"e{k + 1} AS MATERIALIZED (SELECT p.*, {posterior} AS p FROM p, m{k})")
        parts.append(f"m{k + 1} AS MATERIALIZED (SELECT {share} AS share, {accuracy} FROM e{k + 1})")
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({BASE_FAILED}) AS base_failed,"
        f" NOT ({BASE_FAILED}) AND {posterior} >= 0.5 AS kept FROM v, m{rounds}"
    )
