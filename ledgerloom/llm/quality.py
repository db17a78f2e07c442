"""Operator 10: line-first quality rules, in DataFrame functions only.

Each line of a document is judged by itself:

* punctuation: a line of several words that is mostly symbols fails, and so do three or more adjacent lines (with no empty
  line between) that neither end a sentence nor are long enough to be prose, such as lists and menus
  with an item a line. A single heading stays;
* navigation: menus, that is, lines cut up by separators or made of menu words, fail;
* boilerplate: notices about cookies, scripts, rights, subscriptions and sharing fail.

The punctuation rule and the one on separators do not depend on the language; the word lists are English.
Failing lines are removed, and a document that loses too much of its text is rejected, as
is one that fails the base rules (fewer than 10 words, or more than a fifth of its words
in repeated five-word windows). Everything happens within a row: no shuffle.

Defined cases: a null or empty text has no words and fails the base rules; doc_id may be
null or repeated (each row is judged by itself); an empty table gives an empty result;
columns named like results are replaced. Texts of any length are judged whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import WHITE, WHITE_CLASS, carried, documents, strip, words_of

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: A document that loses more than this share of its words' characters is rejected.
MAX_LOST = 0.5
#: Menus and notices are short: only lines of so many words are looked at as such.
MENU_LENGTH, NOTICE_LENGTH = 25, 40
#: A line of so many words is long enough to be prose without an end mark; of shorter ones, so many in a row fail.
PROSE_LENGTH, FRAGMENT_RUN = 15, 3
SYMBOLS = "#*$%&|<>"
#: A line whose words hold more symbols than this share of the number of words fails.
MAX_SYMBOLS_PER_WORD = 0.5
#: Characters that end a sentence, a clause, a quotation or an aside, in several scripts.
END_MARKS = ".!?…。！？:;\"'”’»)]।؟۔።"
SEPARATORS = "|»›•·>"
MENU_WORDS = "home|about|contact|login|logout|register|menu|search|sitemap|help|faq|news|blog|shop|cart|next|previous|prev|back|top|share|print|archive|categories|tags"
BOILERPLATE = (
    r"(?i)(all rights reserved|privacy policy|cookie policy|uses? cookies|accept (all )?cookies|terms of (use|service)|enable javascript"
    r"|javascript (is )?(disabled|required)|lorem ipsum|click here|sign up (for|to)|subscribe to|follow us|share (this|on)|skip to (main )?content|read more|powered by)"
)


def _removed(c: Column, characters: str) -> Column:
    """How many of the characters are in a string."""
    return F.char_length(c) - F.char_length(F.translate(c, characters, ""))


def is_fragment(line: Column, n_words: Column) -> Column:
    """Whether a line with at least one word neither ends a sentence nor is long enough to be prose."""
    return (n_words > 0) & (n_words < PROSE_LENGTH) & (F.call_function("instr", F.lit(END_MARKS), F.right(strip(line), F.lit(1))) == 0)


def line_fails(line: Column, n_words: Column) -> Column:
    """Whether a line with at least one word fails a rule by itself."""
    noisy = (n_words >= 3) & (_removed(line, SYMBOLS) > n_words * MAX_SYMBOLS_PER_WORD)
    separators = _removed(line, SEPARATORS)
    menu = ((separators >= 3) & (separators * 6 >= n_words)) | ((separators >= 2) & (n_words <= 8))
    menu_words = (n_words >= 3) & (n_words <= MENU_LENGTH) & (F.regexp_count(line, F.lit(rf"(?i)\b({MENU_WORDS})\b")) * 10 >= n_words * 6)
    notice = (n_words > 0) & (n_words <= NOTICE_LENGTH) & line.rlike(BOILERPLATE)
    return noisy | menu | menu_words | notice


def _kept_lines(lines: Column) -> Column:
    """The lines that pass, and the empty ones."""
    known = F.transform(lines, lambda x: F.struct(x.alias("line"), F.size(words_of(x)).alias("n")))
    known = F.transform(known, lambda x: F.struct(x["line"].alias("line"), x["n"].alias("n"), is_fragment(x["line"], x["n"]).alias("f")))
    # The name that the lambda binds stands for the array, so that it is computed once and not for each line.
    whole = F.transform(F.array(known), lambda all_: F.filter(all_, lambda x, i: ~_fails(all_, x, i)))
    return F.transform(F.get(whole, F.lit(0)), lambda x: x["line"])


def _fails(lines: Column, x: Column, i: Column) -> Column:
    near = lambda d: F.coalesce(F.when(i + d >= 0, F.get(lines, i + d)["f"]), F.lit(False))
    run = x["f"] & ((near(-2) & near(-1)) | (near(-1) & near(1)) | (near(1) & near(2)))
    return (x["n"] > 0) & (run | line_fails(x["line"], x["n"]))


def _repeat_words(docs: DataFrame) -> DataFrame:
    """Adds n_repeat_words from _words: how many words lie in five-word windows that occur at least twice."""
    n = F.size("_words")
    keyed = docs.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))
    window = lambda i: F.xxhash64(*[F.get(F.col("_h"), i + F.lit(j)) for j in range(WINDOW)])
    none = F.array().cast("array<long>")
    keyed = keyed.withColumn("_g", F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), window)).otherwise(none))
    has = F.size(F.array_distinct("_g")) < F.size("_g")
    pairs = F.sort_array(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    keyed = keyed.withColumn("_s", F.when(has, pairs))
    same = lambda x, k: F.coalesce(F.get(F.col("_s"), k - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get(F.col("_s"), k + 1)["g"] == x["g"], F.lit(False))
    at = F.sort_array(F.transform(F.filter("_s", same), lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate(at, start, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    return keyed.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_h", "_g", "_s")


def judge(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and clean_text."""
    results = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text"]
    docs, restored = carried(docs.drop(*results), ["text"])
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("_words", words_of(F.col("text"))).withColumn("_lines", F.split(text, "\n"))
    out = _repeat_words(out)
    full = F.filter("_lines", lambda x: strip(x) != "")
    out = out.withColumn("n_words", F.size("_words").cast("long")).drop("_words")
    out = out.withColumn("word_chars", F.char_length(F.translate(text, WHITE, "")).cast("long"))
    out = out.withColumn("n_symbols", (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long"))
    out = out.withColumn("n_dup_lines", (F.size(full) - F.size(F.array_distinct(full))).cast("long"))
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT))
    out = out.withColumn("clean_text", F.array_join(_kept_lines(F.col("_lines")), "\n")).drop("_lines")
    left = F.char_length(F.translate(F.col("clean_text"), WHITE, ""))
    out = out.withColumn("kept", ~F.col("base_failed") & (left >= F.col("word_chars") * (1 - MAX_LOST)))
    # Results come out of a generator: a filter on them stays above it. Pushed below, it would put every step's
    # expression into the lambdas of the next, to be evaluated for each word.
    row = F.struct(*[F.col(c) for c in results])
    return restored(out.select(*docs.columns, F.explode(F.array(row)).alias("_row")), "_row.*")


def clean(docs: DataFrame) -> DataFrame:
    """The documents that pass, with failing lines removed from their texts; columns as they were."""
    packed, restored = carried(docs, ["text", "n_chars"])
    out = judge(packed).where("kept").withColumn("text", F.col("clean_text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return restored(out)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judge(documents(spark, sf_dir).select("doc_id", "text")).select(*cols)


OP10_SQL = rf"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), cut AS (
  SELECT doc_id, text, list_filter(regexp_split_to_array(text, '{WHITE_CLASS}+'), lambda x: x <> '') AS words FROM texts
), placed AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM cut
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS times
  FROM (SELECT doc_id, i, word || {" || ".join(f"' ' || lead(word, {j}) OVER o" for j in range(1, WINDOW))} AS g FROM placed WINDOW o AS (PARTITION BY doc_id ORDER BY i))
  WHERE g IS NOT NULL
), repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM windows WHERE times > 1) GROUP BY doc_id
), lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM texts
), counted AS (
  SELECT *, len(list_filter(regexp_split_to_array(line, '{WHITE_CLASS}+'), lambda x: x <> '')) AS n,
         length(regexp_replace(line, '{WHITE_CLASS}', '', 'g')) AS chars,
         length(regexp_replace(line, '[^{SEPARATORS}]', '', 'g')) AS cuts,
         length(regexp_replace(line, '[^{SYMBOLS}]', '', 'g')) AS symbols FROM lines
), judged AS (
  SELECT *, n > 0 AND n < {PROSE_LENGTH} AND strpos('{END_MARKS.replace("'", "''")}', right(regexp_replace(line, '{WHITE_CLASS}+$', ''), 1)) = 0 AS fragment FROM counted
), near AS (
  SELECT *, coalesce(lag(fragment, 1) OVER w, FALSE) AS b1, coalesce(lag(fragment, 2) OVER w, FALSE) AS b2,
         coalesce(lead(fragment, 1) OVER w, FALSE) AS a1, coalesce(lead(fragment, 2) OVER w, FALSE) AS a2
  FROM judged WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), failing AS (
  SELECT doc_id, line, n, chars, n > 0 AND (
    (fragment AND ((b2 AND b1) OR (b1 AND a1) OR (a1 AND a2)))
    OR (n >= 3 AND symbols > n * {MAX_SYMBOLS_PER_WORD}) OR (cuts >= 3 AND cuts * 6 >= n) OR (cuts >= 2 AND n <= 8)
    OR (n BETWEEN 3 AND {MENU_LENGTH} AND len(regexp_extract_all(line, '(?i)\b({MENU_WORDS})\b')) * 10 >= n * 6)
    OR (n <= {NOTICE_LENGTH} AND regexp_matches(line, '{BOILERPLATE}'))) AS fails FROM near
), by_doc AS (
  SELECT doc_id, coalesce(sum(chars) FILTER (NOT fails), 0) AS stays, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS dups FROM failing GROUP BY doc_id
), base AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{WHITE_CLASS}', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words
  FROM cut LEFT JOIN repeats USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(dups AS BIGINT) AS n_dup_lines, n_repeat_words,
       n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT} AS base_failed,
       NOT (n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT}) AND stays >= word_chars * {1 - MAX_LOST} AS kept
FROM base JOIN by_doc USING (doc_id)
"""
