"""Operator 7: secret scans by patterns and a battery of randomness tests, in DataFrame functions only.

Base: three patterns (assignments, access keys, long hexadecimal runs). Beyond them, every
token of 20 or more encoding characters with letters and digits is a candidate. Its encoding
(hexadecimal, base 32, base 36 or base 64) is inferred from its characters, and over that
alphabet it is tested for

* uniformity: chi-squared of the symbol counts,
* runs: changes between the lower and the upper half of the alphabet,
* serial correlation: of each symbol's rank with the next one's.

The three p-values are combined (Fisher); a token that uniform draws would hardly give is
not a secret. Being short is no proof, so tokens must also be far more uniform than
ordinary text of their length: the chi-squared value is held against its non-central
distribution under the letter coincidence of text, and the resulting p-values pass a
Benjamini-Hochberg step within bands of length, over the candidates of all documents. For
that, p-values are counted in bins of a twentieth of a decade, so the step needs a table
of bands and bins only, whose size does not depend on the data.

Defined cases: a null text is empty; a null or repeated doc_id is a row of its own; empty
tables give empty results; other columns are not carried; texts are scanned whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import documents, materialize

#: Fixed patterns and least lengths of the base kinds, in the order that breaks ties.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ["assign", "access", "hex", "random"]
MIN_VALUE = 8

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: Alphabets, and how often two characters of ordinary text in them agree.
ALPHABETS = {
    "hex_lower": ("0123456789abcdef", 0.12),
    "hex_upper": ("0123456789ABCDEF", 0.12),
    "base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.065),
    "base36": ("0123456789abcdefghijklmnopqrstuvwxyz", 0.055),
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.055),
}
#: Candidates whose combined p-value of randomness is below this are not random.
BATTERY_LEVEL = 0.001
#: Share of false discoveries that the step over a band of lengths allows.
FALSE_DISCOVERY = 0.01
BANDS = (20, 32, 64, 128)
BINS_PER_DECADE = 20
#: Matches of a text that are folded at a time.
BLOCK = 256
LAST_BIN = 2000


def _spans(docs: DataFrame, pattern: str, kind: int, least: tuple[int, int] | None = None) -> DataFrame:
    """Adds column _k<kind>: array of (start, kind, end) of the pattern's matches in _text, in code points.

    ``least``: (group, length); matches whose group is shorter are dropped.
    """
    texts, gaps, groups = f"_m{kind}", f"_p{kind}", f"_g{kind}"
    out = docs.withColumn(texts, F.regexp_extract_all("_text", F.lit(pattern), F.lit(0)))
    out = out.withColumn(gaps, F.when(F.size(texts) > 0, F.split("_text", pattern)))
    if least:
        out = out.withColumn(groups, F.when(F.size(texts) > 0, F.regexp_extract_all("_text", F.lit(pattern), F.lit(least[0]))))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def step(acc: Column, i: Column) -> Column:
        start = acc["pos"] + F.char_length(F.get(F.col(gaps), i))
        end = start + F.char_length(F.get(F.col(texts), i))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        found = F.array_append(acc["found"], span)
        if least:
            found = F.when(F.char_length(F.get(F.col(groups), i)) >= least[1], found).otherwise(acc["found"])
        return F.struct(end.alias("pos"), found.alias("found"))

    # A fold that appends copies what it has. So each block of matches is folded by itself, and then the blocks' ends.
    n, first = F.size(texts), F.struct(F.lit(0).alias("pos"), empty.alias("found"))
    within = lambda b: F.sequence(b * BLOCK, F.least(n, (b + 1) * BLOCK) - 1)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: F.aggregate(within(b), first, step))
    out = out.withColumn(f"_b{kind}", F.when(n > 0, blocks))
    begin = F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("at"))
    starts = F.aggregate(f"_b{kind}", begin, lambda acc, b: F.struct((acc["pos"] + b["pos"]).alias("pos"), F.array_append(acc["at"], acc["pos"]).alias("at")), lambda acc: acc["at"])
    moved = lambda b, at: F.transform(b["found"], lambda s: F.struct((s["start"] + at).alias("start"), s["kind"].alias("kind"), (s["end"] + at).alias("end")))
    folded = F.flatten(F.zip_with(f"_b{kind}", starts, moved))
    out = out.withColumn(f"_k{kind}", F.coalesce(folded, empty))
    return out.drop(gaps, groups, f"_b{kind}", *([] if kind == 3 else [texts]))


def _upper(z: Column) -> Column:
    """Upper tail of the standard normal distribution, right to three parts in a thousand however far out (Borjesson and Sundberg)."""
    x = F.abs(z)
    tail = F.exp(-x * x / 2) / (math.sqrt(2 * math.pi) * (0.661 * x + 0.339 * F.sqrt(x * x + 5.51)))
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _pick(alphabet: Column, of: dict[str, object]) -> Column:
    out = None
    for name, value in of.items():
        out = F.when(alphabet == name, F.lit(value)) if out is None else out.when(alphabet == name, F.lit(value))
    return out


def battery(tokens: DataFrame) -> DataFrame:
    """``tokens`` (token) with encoding, n, chi2, p_uniform, p_runs, p_serial, p_random, p_text."""
    t = F.col("token")
    encoding = (
        F.when(t.rlike("^[0-9a-f]+$"), "hex_lower").when(t.rlike("^[0-9A-F]+$"), "hex_upper").when(t.rlike("^[A-Z2-7]+$"), "base32").when(t.rlike("^[a-z0-9]+$"), "base36").otherwise("base64")
    )
    out = tokens.withColumn("encoding", encoding).withColumn("_s", F.translate(t, "-_", "+/")).withColumn("n", F.char_length("_s"))
    out = out.withColumn("_a", _pick(F.col("encoding"), {k: a for k, (a, _) in ALPHABETS.items()}))
    out = out.withColumn("_k", F.char_length("_a"))
    halves = {k: "".join("0" if i < len(a) // 2 else "1" for i in range(len(a))) for k, (a, _) in ALPHABETS.items()}
    n, k = F.col("n"), F.col("_k")
    square = lambda c: F.pow(n - F.char_length(F.replace(F.col("_s"), c, F.lit(""))), F.lit(2))
    squares = F.aggregate(F.split("_a", ""), F.lit(0.0), lambda acc, c: acc + F.when(c == "", 0.0).otherwise(square(c)))
    out = out.withColumn("chi2", squares * k / n - n)
    # Wilson and Hilferty: the cube root of chi-squared over its degrees of freedom is close to normal.
    free = k - 1
    z = (F.cbrt(F.greatest(F.col("chi2"), F.lit(0.0)) / free) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    out = out.withColumn("p_uniform", _upper(z))
    out = out.withColumn("_b", F.translate("_s", "".join(ALPHABETS["base64"][0]), halves["base64"]))
    for name in ALPHABETS:
        if name != "base64":
            out = out.withColumn("_b", F.when(F.col("encoding") == name, F.translate("_s", ALPHABETS[name][0], halves[name])).otherwise(F.col("_b")))
    changes = F.regexp_count("_b", F.lit("0(?=1)|1(?=0)"))
    out = out.withColumn("p_runs", 2 * _upper(F.abs((changes - (n - 1) / 2) / F.sqrt((n - 1) / 4))))
    out = out.withColumn("_x", F.transform(F.split("_s", ""), lambda c: F.call_function("instr", F.col("_a"), c) - 1 - (k - 1) / 2))
    out = out.withColumn("_x", F.slice(F.col("_x"), F.lit(1), n))
    fold = F.aggregate("_x", F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("last")), lambda acc, x: F.struct((acc["sum"] + acc["last"] * x).alias("sum"), x.cast("double").alias("last")), lambda acc: acc["sum"])
    out = out.withColumn("p_serial", 2 * _upper(F.abs(fold / (F.sqrt(n - 1) * (k * k - 1) / 12))))
    half = -(F.log(F.greatest("p_uniform", F.lit(1e-300))) + F.log(F.greatest("p_runs", F.lit(1e-300))) + F.log(F.greatest("p_serial", F.lit(1e-300))))
    out = out.withColumn("p_random", F.exp(-half) * (1 + half + half * half / 2))
    excess = n * (k * _pick(F.col("encoding"), {name: c for name, (_, c) in ALPHABETS.items()}) - 1)
    out = out.withColumn("p_text", _upper((free + excess - F.col("chi2")) / F.sqrt(2 * free + 4 * excess)))
    return out.drop("_s", "_a", "_k", "_b", "_x")


def scan(docs: DataFrame, false_discovery: float = FALSE_DISCOVERY, battery_level: float = BATTERY_LEVEL) -> DataFrame:
    """A row (doc_id, spans) for each document: all (start, kind, end), sorted; kind is an index of ``KINDS``."""
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    out = _spans(out, ASSIGN, 0, (2, MIN_VALUE))
    out = _spans(out, ACCESS, 1)
    out = _spans(out, HEX, 2)
    out = _spans(out, CANDIDATE, 3)
    mixed = lambda x: x["token"].rlike("[0-9]") & x["token"].rlike("[A-Za-z]")
    tokens = F.filter(F.zip_with("_k3", "_m3", lambda s, m: F.struct(s["start"].alias("start"), s["end"].alias("end"), m.alias("token"))), mixed)
    rows = materialize(out.select("doc_id", F.concat("_k0", "_k1", "_k2").alias("base"), tokens.alias("tokens")), "secrets-found")
    # Equal tokens have equal p-values, so each distinct token is tested once; the counts are of all occurrences.
    tested = battery(rows.select(F.explode("tokens.token").alias("token")).groupBy("token").agg(F.count("*").alias("times")))
    band = F.lit(0)
    for i, low in enumerate(BANDS):
        band = F.when(F.col("n") >= low, i).otherwise(band)
    at = F.least(F.lit(LAST_BIN), F.floor(-BINS_PER_DECADE * F.log10(F.greatest("p_text", F.lit(1e-300))))).cast("int")
    tested = materialize(tested.select("token", "times", band.alias("band"), at.alias("bin"), (F.col("p_random") >= battery_level).alias("random")), "secrets-tested")
    bins = tested.groupBy("band", "bin").agg(F.sum("times").alias("c"))
    above = Window.partitionBy("band").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = bins.withColumn("cum", F.sum("c").over(above)).withColumn("m", F.sum("c").over(Window.partitionBy("band")))
    passing = bins.where(F.pow(F.lit(10.0), -F.col("bin") / BINS_PER_DECADE) * F.col("m") <= F.col("cum") * false_discovery)
    least = passing.groupBy("band").agg(F.min("bin").alias("least"))
    flagged = tested.where("random").join(F.broadcast(least), "band").where(F.col("bin") >= F.col("least")).select("token")
    if not flagged.take(1):
        return rows.select("doc_id", F.sort_array("base").alias("spans"))
    # A document's flagged tokens come back to it by token; only rows of tokens are shuffled, never texts.
    ids = rows.withColumn("_row", F.monotonically_increasing_id())
    ids = materialize(ids, "secrets-rows")
    free = ids.select("_row", "base", F.explode("tokens").alias("t"))
    free = free.where(~F.exists("base", lambda b: (b["start"] < F.col("t.end")) & (F.col("t.start") < b["end"])))
    hits = free.select("_row", F.col("t.token").alias("token"), F.struct(F.col("t.start").alias("start"), F.lit(3).alias("kind"), F.col("t.end").alias("end")).alias("span"))
    hits = hits.join(flagged, "token", "left_semi").groupBy("_row").agg(F.collect_list("span").alias("more"))
    joined = ids.select("_row", "doc_id", "base").join(hits, "_row", "left")
    return joined.select("doc_id", F.sort_array(F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,end:int>>")))).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = span_text(F.filter("spans", lambda s: s["kind"] < 3))
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(F.encode(base, "UTF-8"), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))
