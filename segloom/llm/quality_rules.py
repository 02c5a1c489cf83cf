"""Quality rules as weak supervision: rules vote or abstain, EM estimates how often each is right, a posterior decides.

Rules look at counts of one text. The corpus enters through the number of documents that have each pattern of
votes, at most 3**8 of them whatever the input; EM runs on those numbers until they stand still. The shares that it
estimates have Beta priors worth PRIOR documents and no bounds: a rule whose votes say nothing about the others'
ends with a weight near zero, whatever its prior. No Python runs on executors.

Defined cases: a null text counts as empty; empty tables give no rows and the starting rates; repeated rows are
judged each by itself; other columns pass through, and a column with the name of a result is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, let, own_columns, read, split_words, table, text_or_empty

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_lines", "n_upper", "n_marks", "n_bare"]
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Documents that the priors are worth; the prior share of good texts, and of right votes on good and on bad texts. Most
#: bad texts are bad in one way only, so the other rules may well praise them; a good text is seldom blamed.
PRIOR, GOOD, RIGHT = 100, 0.8, (0.97, 0.4)


def repeated_words(words: Column) -> Column:
    """Words inside windows of three words that the text has twice or more, each word once.

    Windows are compared by 64-bit hashes; sorted with their positions, equal ones are neighbours.
    """
    hashes = F.when(
        F.size(words) >= 3,
        F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(placed: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(placed, k)["h"] == x["h"], F.lit(False))
        again = F.filter(placed, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return let(
            F.sort_array(F.transform(again, lambda x: x["p"])),
            lambda at: F.aggregate(F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3)))), F.lit(0), lambda a, b: a + b),
        )

    def counted(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(placed, covered))

    return let(hashes, counted).cast("long")


def with_counts(df: DataFrame) -> DataFrame:
    """Adds COUNTS and EXTRA to ``df``."""
    words = F.col("__words")
    lines = F.col("__lines")
    named = df.drop(*COUNTS, *EXTRA).withColumn("__text", text_or_empty())
    split = named.withColumns({"__words": split_words(F.col("__text")), "__lines": F.filter(F.split("__text", "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")})
    counted = split.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count("__text", F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeated_words(words),
        "n_lines": F.size(lines).cast("long"),
        "n_upper": F.regexp_count("__text", F.lit(r"\p{Lu}")).cast("long"),
        "n_marks": F.regexp_count("__text", F.lit(r"[^\p{L}\p{M}\s]")).cast("long"),
        "n_bare": F.regexp_count("__text", F.lit(r"(?:^|\s)[^\p{L}\p{N}\s]+(?=\s|$)")).cast("long"),
    })
    return counted.drop("__text", "__words", "__lines")


def _between(bad: Column, good: Column) -> Column:
    """-1 where ``bad`` holds, 1 where ``good`` does, else 0."""
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Each rule's vote: 1 for a good text, -1 for a bad one, 0 to abstain."""
    n, chars = F.col("n_words"), F.greatest(F.col("word_chars"), F.lit(1))
    mean = F.col("word_chars") / F.greatest(n, F.lit(1))
    share = lambda x, y: F.col(x) / F.greatest(y, F.lit(1))
    return {
        "length": _between(n < MIN_WORDS, n >= 2 * MIN_WORDS),
        "repeats": _between(share("n_repeat_words", n) > 0.3, share("n_repeat_words", n) < 0.15),
        "symbols": _between(share("n_symbols", n) > 0.15, share("n_symbols", n) < 0.05),
        "dup_lines": _between(share("n_dup_lines", F.col("n_lines")) > 0.3, share("n_dup_lines", F.col("n_lines")) < 0.05),
        "word_length": _between((mean < 2.5) | (mean > 13), (mean >= 3) & (mean <= 10)),
        "capitals": _between(share("n_upper", chars) > 0.4, share("n_upper", chars) < 0.15),
        "marks": _between(share("n_marks", chars) > 0.25, share("n_marks", chars) < 0.12),
        "bare": _between(share("n_bare", n) > 0.15, share("n_bare", n) < 0.05),
    }


@dataclass(frozen=True)
class Votes:
    """Share of good texts, and for each rule how often it votes rightly on good and on bad texts when it votes."""

    good: float
    right: dict[str, tuple[float, float]]

    def weights(self, rule: str) -> tuple[float, float]:
        """What the rule's praise and blame add to the log odds of a good text."""
        on_good, on_bad = self.right[rule]
        return log(on_good / (1 - on_bad)), log((1 - on_good) / on_bad)

    def log_odds(self, pattern: dict[str, int]) -> float:
        return log(self.good / (1 - self.good)) + sum(self.weights(k)[vote < 0] for k, vote in pattern.items() if vote)


def fit(counted: DataFrame, rounds: int = 200, least_change: float = 1e-6) -> Votes:
    """EM over the numbers of documents by pattern of votes."""
    names = list(rules())
    rows = counted.select(*[v.alias(k) for k, v in rules().items()]).groupBy(*names).count().collect()
    return estimate([({k: row[k] for k in names}, row["count"]) for row in rows], rounds, least_change)


def estimate(patterns: list[tuple[dict[str, int], int]], rounds: int = 200, least_change: float = 1e-6) -> Votes:
    """The most likely shares under the priors, from patterns of votes with the number of their documents."""
    names = list(rules())
    votes = Votes(GOOD, dict.fromkeys(names, RIGHT))
    for _ in range(rounds if patterns else 0):
        total, good = float(PRIOR), PRIOR * GOOD
        seen = {k: [PRIOR * RIGHT[0], float(PRIOR), PRIOR * RIGHT[1], float(PRIOR)] for k in names}  # right and all votes on good texts, then on bad ones
        for pattern, n in patterns:
            p = 1 / (1 + exp(-votes.log_odds(pattern)))
            total, good = total + n, good + p * n
            for k, vote in pattern.items():
                if vote:
                    s = seen[k]
                    s[0], s[1] = s[0] + p * n * (vote > 0), s[1] + p * n
                    s[2], s[3] = s[2] + (1 - p) * n * (vote < 0), s[3] + (1 - p) * n
        now = Votes(good / total, {k: (s[0] / s[1], s[2] / s[3]) for k, s in seen.items()})
        change = max(abs(now.good - votes.good), *(abs(x - y) for k in names for x, y in zip(now.right[k], votes.right[k], strict=True)))
        votes = now
        if change < least_change:
            break
    return votes


def judge(counted: DataFrame, votes: Votes, min_words: int = MIN_WORDS) -> DataFrame:
    """Adds ``base_failed`` (too short, or mostly repeats), ``quality`` (the posterior that the text is good) and ``kept``."""
    odds = F.lit(log(votes.good / (1 - votes.good)))
    for k, vote in rules().items():
        praise, blame = votes.weights(k)
        odds = odds + F.when(vote > 0, praise).when(vote < 0, blame).otherwise(0.0)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumns({"base_failed": failed, "quality": 1 / (1 + F.exp(-odds))}).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = checkpoint(with_counts(read(spark, sf_dir, "documents")).select("doc_id", *COUNTS, *EXTRA))
    return judge(counted, fit(counted)).select("doc_id", *COUNTS, "base_failed", "kept", "quality")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are kept. A short text isn't out for that alone here: its length is one vote of several.

    Texts are counted once, beside the documents, and never shuffled.
    """
    counted = table(with_counts(docs.select(own_columns(docs), "text")).select("__own", *COUNTS, *EXTRA))
    return judge(counted, fit(counted), min_words=0).where("kept").select("__own.*")
