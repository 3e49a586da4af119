"""Quality rules as one projection: measures of a text, a threshold table over them, a verdict.

Everything is a column expression; no user function runs. A table of ``Rule`` rows is compiled into one boolean
expression, so another rule set is another table, not other code.

Defined results: a null text counts as empty; an empty text has zero for every measure and fails the word minimum.
Ratios over zero words or lines are zero. Texts of any length are measured whole: repeated windows are found by
sorting the window hashes (64 bits each) of the text with their positions, never by comparing all pairs. Repeated
rows give repeated results; tables without rows give none. Other columns of the input pass through ``add_measures``
untouched unless they bear the name of a measure, which then holds the measure.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulsegrid.llm.common import SPACE_CLASS, llm_query, table, words_of

# Frequent function words of the four languages in the corpus; a text of prose has some of them.
STOP_WORDS = (
    "the of and to in a is that it on for was with as be by this at are from "
    "der die und den das von zu mit ein eine ist im nicht sich auf für "
    "le la les de des et un une du que est en pour dans sur "
    "el los las y por con para del se su no al"
).split()


@dataclass(frozen=True)
class Rule:
    """Bounds on one measure; ``None`` leaves that side open."""

    measure: str
    least: float | None = None
    most: float | None = None


BASE_RULES = (Rule("n_words", least=50),)

RULES = (
    Rule("mean_word_chars", least=2.0, most=14.0),
    Rule("symbol_ratio", most=0.10),
    Rule("stop_word_ratio", least=0.02),
    Rule("dup_line_ratio", most=0.5),
)

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words", "n_repeat_words",
    "mean_word_chars", "symbol_ratio", "stop_word_ratio", "dup_line_ratio", "repeat_ratio",
)


def _repeated() -> Column:
    """Words covered by windows of three that occur twice or more, from the sorted (hash, position) pairs."""
    neighbour = lambda k: F.get("_placed", k)["h"]
    starts = F.array_compact(
        F.transform(
            "_placed",
            lambda x, k: F.when((neighbour(k - 1) == x["h"]) | (neighbour(k + 1) == x["h"]), x["i"]),
        )
    )
    covered = F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))
    return F.size(F.array_distinct(covered)).cast("long")


def add_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measures of every text. One narrow pass over the rows; nothing is shuffled."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in MEASURES and c not in _TEMPORARY]
    body = F.coalesce(F.col(text), F.lit(""))
    stop = [form for word in dict.fromkeys(STOP_WORDS) for form in (word, word.capitalize())]
    n = F.size("_words")
    split = docs.withColumns(
        {
            "_words": words_of(body),
            "_lines": F.filter(F.split(body, "\n"), lambda line: line.rlike(f"[^{SPACE_CLASS}]")),
        }
    )
    hashed = split.withColumn(
        "_hashes",
        F.when(
            n >= 3,
            F.transform(
                F.sequence(F.lit(0), n - 3),
                lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)),
            ),
        ),
    )
    # Only texts in which some window occurs twice are sorted.
    placed = hashed.withColumn(
        "_placed",
        F.when(
            F.size(F.array_distinct("_hashes")) < F.size("_hashes"),
            F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    counted = placed.select(
        *kept,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_words", lambda w: w.isin(stop))).cast("long").alias("n_stop_words"),
        F.when(F.col("_placed").isNull(), F.lit(0).cast("long")).otherwise(_repeated()).alias("n_repeat_words"),
    )

    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)

    return counted.withColumns(
        {
            "mean_word_chars": share("word_chars", "n_words"),
            "symbol_ratio": share("n_symbols", "n_words"),
            "stop_word_ratio": share("n_stop_words", "n_words"),
            "dup_line_ratio": share("n_dup_lines", "n_lines"),
            "repeat_ratio": share("n_repeat_words", "n_words"),
        }
    )


_TEMPORARY = ("_words", "_lines", "_hashes", "_placed")


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """One boolean expression: true if every measure lies within its bounds."""
    bounds = [F.col(r.measure) >= r.least for r in rules if r.least is not None]
    bounds += [F.col(r.measure) <= r.most for r in rules if r.most is not None]
    return reduce(lambda a, b: a & b, bounds, F.lit(True))


def verdicts(
    docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES
) -> DataFrame:
    """``add_measures`` plus ``base_failed`` (too short, or over half of it repeats) and ``kept``."""
    measured = add_measures(docs, text)
    repeats = 100 * F.col("n_repeat_words") > 50 * F.col("n_words")
    return measured.withColumn("base_failed", ~compile_rules(base) | repeats).withColumn(
        "kept", ~F.col("base_failed") & compile_rules(rules)
    )


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text passes every rule, with the columns they came with."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    judged = verdicts(packed.withColumn("_text", F.col(f"_row.`{text}`")), "_text")
    # The running number keeps the optimizer from moving the filter below the measures, which would compute each of
    # them anew wherever the verdict names it.
    numbered = judged.withColumn("_number", F.monotonically_increasing_id())
    return numbered.where(F.col("kept") & (F.col("_number") >= 0)).select("_row.*")


def _sql() -> str:
    stop = ", ".join(f"'{form}'" for w in dict.fromkeys(STOP_WORDS) for form in (w, w.capitalize()))
    checks = [f"{r.measure} >= {r.least}" for r in RULES if r.least is not None]
    checks += [f"{r.measure} <= {r.most}" for r in RULES if r.most is not None]
    word = r"[^\x20\x09-\x0D]"
    return f"""
WITH texts AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents
), split AS (
  SELECT k, doc_id, text, regexp_extract_all(text, '{word}+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines
  FROM texts
), windows AS (
  SELECT k, i, list_slice(words, i, i + 2) AS w
  FROM (SELECT k, words, unnest(range(1, len(words) - 1)) AS i FROM split)
), twice AS (
  SELECT k, unnest(list(i)) AS i FROM windows GROUP BY k, w HAVING count(*) > 1
), covered AS (
  SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY k
), measures AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
         len(list_filter(words, lambda w: w IN ({stop}))) AS n_stop_words, len(lines) AS n_lines
  FROM split LEFT JOIN covered USING (k)
), ratios AS (
  SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars,
         CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbol_ratio,
         CASE WHEN n_words > 0 THEN n_stop_words / n_words ELSE 0 END AS stop_word_ratio,
         CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio,
         (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed
  FROM measures
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND {" AND ".join(checks)}) AS kept
FROM ratios"""


@llm_query("op10_quality_rules", _sql())
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    return verdicts(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
