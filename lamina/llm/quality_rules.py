"""Quality rules as a threshold table, compiled into one projection of built-in functions (no Python on the executors).

``measure`` turns a text into its base counts and ratios, ``RULES`` holds the thresholds, and
``apply_rules`` compiles both into a single select. Every document is judged alone: no shuffle.

Defined cases. A null or empty text, or one of white space only, has no words: all counts are 0, every
ratio is 0, it fails the base rule (fewer than 50 words) and isn't kept. A text of fewer than three
words has no windows. Repeated rows are judged one by one; an empty table gives an empty result; columns
of the input other than id and text are not looked at and not returned, so their names can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import SPACES, id_text, let

_STOP = (
    "the of and to in a is that it for on was be with as by this are at from or an not which have "
    "der die das und in den von zu mit ist des auf für im ein eine nicht dem sich als auch "
    "le la les de des et un une en du que qui est dans pour par sur pas au avec ce "
    "el los las del y se con por para su lo como más al una no"
).split()
#: Function words of the four languages, as they stand in running text.
STOP_FORMS = sorted({f + end for w in _STOP for f in (w, w.capitalize()) for end in ("", ".", ",", ";", ":")})


@dataclass(frozen=True)
class Rule:
    """Keep only if ``low <= metric <= high``."""

    name: str
    metric: str
    low: float
    high: float


#: The verdict of the method, beyond the base rule.
RULES = (
    Rule("mean_word_length", "mean_word_length", 2.0, 13.0),
    Rule("symbol_ratio", "symbol_ratio", 0.0, 0.10),
    Rule("stop_word_ratio", "stop_word_ratio", 0.02, 0.95),
    Rule("dup_line_ratio", "dup_line_ratio", 0.0, 0.5),
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t-\r]+", -1))


def _repeat_words(words: Column) -> Column:
    """How many words stand in a window of three words that the text has twice or more."""

    def covered(windows: Column) -> Column:
        placed = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

        def starts(s: Column) -> Column:
            last = F.size(s) - 1
            same = lambda a, b: F.get(s, a)["w"] == F.get(s, b)["w"]
            return F.filter(
                F.transform(s, lambda x, k: F.when(((k > 0) & same(k, k - 1)) | ((k < last) & same(k, k + 1)), x["i"])),
                lambda i: i.isNotNull(),
            )

        return F.aggregate(
            F.array_sort(let(placed, starts)),
            F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at")),
            lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["at"])).alias("n"), i.alias("at")),
            lambda acc: acc["n"],
        )

    def of(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(covered(windows))

    windows = lambda ws: F.transform(
        F.sequence(F.lit(0), F.size(ws) - 3),
        lambda i: F.concat_ws(" ", F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)),
    )
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(words, lambda ws: let(windows(ws), of)))


def measured(text: Column) -> Column:
    """One struct of the base counts and the ratios that rules refer to. Words and lines are bound to lambda
    variables, so however often the result is referred to, or a filter on it is moved, the text is split once."""
    has_word = lambda line: F.btrim(line, F.lit(SPACES)) != ""
    over = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))

    def counts(ws: Column) -> Column:
        lines = let(F.filter(F.split(text, "\n", -1), has_word), lambda ls: F.struct(F.size(ls).alias("n"), (F.size(ls) - F.size(F.array_distinct(ls))).alias("dup")))
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            lines.alias("lines"),
            _repeat_words(ws).cast("long").alias("n_repeat_words"),
            F.size(F.filter(ws, lambda w: w.isin(STOP_FORMS))).alias("stop_words"),
        )

    def ratios(c: Column) -> Column:
        return F.struct(
            *(c[n].alias(n) for n in ("n_words", "word_chars", "n_symbols")),
            c["lines"]["dup"].cast("long").alias("n_dup_lines"),
            c["n_repeat_words"].alias("n_repeat_words"),
            over(c["word_chars"], c["n_words"]).alias("mean_word_length"),
            over(c["n_symbols"], c["word_chars"]).alias("symbol_ratio"),
            over(c["stop_words"], c["n_words"]).alias("stop_word_ratio"),
            over(c["lines"]["dup"], c["lines"]["n"]).alias("dup_line_ratio"),
        )

    return let(let(_words(text), counts), ratios)


def _base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def apply_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: base counts, ratios, ``base_failed``, ``failed_rules`` (names, in table order) and ``kept``."""
    m = id_text(df, id_col, text_col).select("doc_id", measured(F.col("text")).alias("m"))
    failed = [F.when(~F.col("m")[r.metric].between(r.low, r.high), F.lit(r.name)) for r in rules]
    judged = m.select(
        "doc_id",
        "m.*",
        _base_failed(F.col("m")).alias("base_failed"),
        (F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")).alias("failed_rules"),
    )
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def kept_rows(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``df`` that the rules keep, with all their columns: one filter, no join, so null or repeated ids don't matter."""

    def verdict(m: Column) -> Column:
        good = ~_base_failed(m)
        for r in rules:
            good = good & m[r.metric].between(r.low, r.high)
        return good

    return df.filter(let(measured(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))), verdict))


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same for DuckDB, over the view ``documents``."""
    quoted = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_FORMS)
    keep = " AND ".join(f"{r.metric} BETWEEN {r.low!r} AND {r.high!r}" for r in rules) or "true"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
p AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS n FROM p),
r AS (SELECT rid, count(DISTINCT i + k) AS n FROM g, (SELECT unnest([0, 1, 2]) AS k) WHERE n >= 2 GROUP BY rid),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(length(array_to_string(ws, '')), 0)::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
             len(list_filter(ws, lambda x: x IN ({quoted}))) AS n_stop, len(ls) AS n_lines
      FROM w LEFT JOIN r USING (rid)),
x AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
             CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0.0 END AS mean_word_length,
             CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0.0 END AS symbol_ratio,
             CASE WHEN n_words > 0 THEN n_stop / n_words ELSE 0.0 END AS stop_word_ratio,
             CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0.0 END AS dup_line_ratio FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {keep} AS kept FROM x"""
