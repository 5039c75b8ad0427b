"""Quality rules, line first, in DataFrame expressions only.

Every line with a word is held against punctuation, navigation and boilerplate rules; failing lines are removed, and a
document that loses too much of its text this way, or fails the base rules, is not kept. All work is per row: nothing
is shuffled, so no key or source can be hot.

Repeated words are counted on hashes: each 8-word window gets a 64-bit hash; where some are equal, hashes are sorted
together with their positions in one array of longs, equal neighbours are repeats (confirmed on all 64 bits), and the
words that the repeated windows cover are summed from the gaps between them. Positions take the low bits, so a window
unlike a repeated one that agrees with it in the top 41 bits (33 in texts beyond 8 million words) could come between two
repeats and hide one; that is one pair of windows in 2**41.

Edge cases: a null text has no words; a text without words fails the base rules (fewer than 20 words); lines are cut at
``\\n`` only and compared as they are; lines without a word never count; repeated rows and null ids are rated each;
columns of the input other than those named are ignored, so clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RE, SPACES, held_back

SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEAT = 30
#: A document is kept while at least this share (per cent) of the characters of its lines survives.
LEAST_LEFT = 50
ENDS = r"[.!?\x{2026}\x{3002}\x{FF01}\x{FF1F}][\"')\]\x{201D}\x{00BB}]*[\x20\x09-\x0D]*$"
INSIDE = r"[.!?\x{2026}][\"')\x{201D}\x{00BB}]*[\x20\x09]"
BOILERPLATE = (
    r"(?i)(all rights reserved|privacy policy|terms of (use|service)|cookie (policy|settings)|(accept|uses?) cookies|enable javascript"
    r"|click here|read more|sign (up|in) (to|for|now)|log ?in to|subscribe to|share (this|on)|follow us|skip to (main )?content|back to top)"
)


def words_of(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RE))


def positions_mask(n: Column) -> Column:
    """Low bits that hold a position beside a hash: 23 where positions fit, else 31."""
    return F.when(n < 1 << 23, F.lit((1 << 23) - 1)).otherwise(F.lit((1 << 31) - 1)).cast("long")


def beside(hashes: Column, mask: Column) -> Column:
    """Hashes with their low bits replaced by their position, sorted: equal hashes are neighbours, by position."""
    return F.sort_array(F.transform(hashes, lambda h, i: h.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long"))))


def _joined(name: str, step: int) -> Column:
    """Hashes of windows twice as long, from windows of ``step`` words."""
    c = F.col(name)
    n = F.greatest(F.size(c) - step, F.lit(0))
    return F.zip_with(F.slice(c, F.lit(1), n), F.slice(c, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))


def line_passes(line: Column) -> Column:
    """Whether a line holds prose: the punctuation, navigation and boilerplate rules."""
    n = F.size(F.split(F.btrim(line, F.lit(SPACES)), SPACE_RE))
    bars = (F.length(line) - F.length(F.replace(line, F.lit(" | ")))) / 3
    shouts = (F.length(line) - F.length(F.replace(line, F.lit("!!")))) / 2
    odd = F.length(line) - F.length(F.translate(line, SYMBOLS, ""))
    punctuated = line.rlike(ENDS) | (line.rlike(INSIDE) & (n >= 8))
    navigation = (bars >= 3) & (8 * bars >= n)
    return punctuated & ~navigation & (4 * shouts < n) & (4 * odd < 3 * n) & ~line.rlike(BOILERPLATE)


def rate(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, clean_text."""
    df = docs.select(F.col("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    df = df.select("doc_id", "t", words_of(F.col("t")).alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    df = df.select("doc_id", "t", "lines", F.size("w").alias("n"), F.transform("w", lambda x: F.xxhash64(x)).alias("h1"))
    for step in (1, 2, 4):
        df = df.select("doc_id", "t", "lines", "n", _joined(f"h{step}", step).alias(f"h{2 * step}"))
    df = df.withColumn("mask", positions_mask(F.col("n")))
    # most texts repeat no window: theirs are not sorted
    df = df.withColumn("s", F.when(F.size(F.array_distinct("h8")) < F.size("h8"), beside(F.col("h8"), F.col("mask"))).otherwise(F.array().cast("array<bigint>")))
    s, h, mask = F.col("s"), F.col("h8"), F.col("mask")
    at = lambda x: x.bitwiseAND(mask).cast("int")
    top = lambda x: x.bitwiseAND(F.bitwise_not(mask))
    same = lambda x, y: (top(x) == top(y)) & (F.get(h, at(x)) == F.get(h, at(y)))
    met = F.filter(s, lambda x, i: ((i > 0) & F.coalesce(same(F.get(s, i - 1), x), F.lit(False))) | F.coalesce(same(F.get(s, i + 1), x), F.lit(False)))
    df = df.withColumn("met", met)
    df = df.withColumn("q", F.sort_array(F.transform("met", lambda x: x.bitwiseAND(F.col("mask")))))
    q, m = F.col("q"), F.size("q")
    gaps = F.zip_with(F.slice(q, F.lit(1), F.greatest(m - 1, F.lit(0))), F.slice(q, F.lit(2), F.greatest(m - 1, F.lit(0))), lambda a, b: F.least(b - a, F.lit(WINDOW).cast("long")))
    covered = F.when(m > 0, F.aggregate(gaps, F.lit(WINDOW).cast("long"), lambda a, g: a + g)).otherwise(F.lit(0).cast("long"))
    df = df.select("doc_id", "t", "lines", F.col("n").cast("long").alias("n_words"), held_back(covered).alias("n_repeat_words"), F.filter("lines", line_passes).alias("good"))
    chars = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    t = F.col("t")
    df = df.select(
        "doc_id", "n_words", F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
        ((F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT * F.col("n_words"))).alias("base_failed"),
        (100 * chars("good") >= LEAST_LEFT * chars("lines")).alias("enough"), F.array_join("good", "\n").alias("clean_text"),
    )
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("enough")).alias("kept"), "clean_text")


#: The same in DuckDB.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
p AS (SELECT doc_id, unnest(generate_series(1, len(w) - 7)) AS i, w FROM w WHERE len(w) >= 8),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS x FROM p),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM g) WHERE c > 1),
c AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, t, w, lines, list_filter(lines, lambda x:
        (regexp_matches(x, '[.!?\x{2026}\x{3002}\x{FF01}\x{FF1F}]["'')\]\x{201D}\x{00BB}]*[\x20\x09-\x0D]*$')
         OR (regexp_matches(x, '[.!?\x{2026}]["'')\x{201D}\x{00BB}]*[\x20\x09]') AND len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) >= 8))
        AND NOT ((length(x) - length(replace(x, ' | ', ''))) / 3 >= 3
                 AND 8 * (length(x) - length(replace(x, ' | ', ''))) / 3 >= len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')))
        AND 4 * (length(x) - length(replace(x, '!!', ''))) / 2 < len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> ''))
        AND 4 * (length(x) - length(translate(x, '#*$%&|<>', ''))) < 3 * len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> ''))
        AND NOT regexp_matches(x, '(?i)(all rights reserved|privacy policy|terms of (use|service)|cookie (policy|settings)|(accept|uses?) cookies|enable javascript|click here|read more|sign (up|in) (to|for|now)|log ?in to|subscribe to|share (this|on)|follow us|skip to (main )?content|back to top)')) AS good FROM w),
b AS (SELECT l.doc_id, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
             (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(c.n, 0)::BIGINT AS n_repeat_words,
             coalesce(list_sum(list_transform(good, lambda x: length(x))), 0) AS left_chars, coalesce(list_sum(list_transform(lines, lambda x: length(x))), 0) AS all_chars
      FROM l LEFT JOIN c ON l.doc_id = c.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * left_chars >= 50 * all_chars AS kept
FROM b
"""
