"""Quality rules as a bitmask ledger: evaluate once, decide many times.

``ledger`` reads every text once and stores measurements and one failure bit
per rule in ``fail_bits``. A policy is a versioned set of rules, that is a
mask: a document is kept where ``fail_bits & mask = 0``. Changing a policy or
asking what a rule costs (``ablations``) reads the ledger's integers, never the
texts. Only Spark SQL expressions are used.

Words are runs of characters other than ``\\x20\\x09-\\x0D``. A repeated window
is eight consecutive words found twice or more in the same text (compared by
64-bit hash of the words).

Edge cases: null and empty texts have no words and fail ``few_words``; a null
``doc_id`` is an ordinary value; repeated rows each get a ledger row; an empty
table gives an empty ledger. Only ``doc_id`` and the text column are read, so
extra columns never clash with results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
SPACES = "[ \\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"

# rule name -> condition of failure over the measurements; its place is its bit
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbol_heavy": "10 * n_symbols > n_words",
    "repeated_lines": "n_lines >= 4 and 100 * n_dup_lines > 30 * n_lines",
    "long_words": "word_chars > 14 * n_words",
    "short_words": "word_chars < 2 * n_words",
}
# versioned policies: the rules that reject; a new version is added, never edited
POLICIES: dict[int, tuple[str, ...]] = {
    1: ("few_words", "repeated_windows"),
    2: ("few_words", "repeated_windows", "symbol_heavy", "repeated_lines", "long_words", "short_words"),
}
BASE_POLICY, POLICY = 1, 2


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(version: int) -> int:
    return sum(bit(r) for r in POLICIES[version])


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id with the measurements of each text.

    Each array is referred to at least twice where it is used inside a lambda,
    so that the optimiser computes it once per row instead of inlining it.
    """
    df = docs.select(F.col("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    df = df.select("doc_id", "t",
                   F.filter(F.split("t", SPACES), lambda w: w != "").alias("words"),
                   F.filter(F.split("t", "\n"), lambda s: s.rlike("[^ \\x09-\\x0D]")).alias("lines"))
    n = F.size("words")
    df = df.select(
        "doc_id", n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)),
                                        lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).alias("prints"))
    # most texts have no repeated window: a hash set tells, and they stop here
    twice = F.size(F.array_distinct("prints")) < F.size("prints")
    df = df.withColumn("ranked", F.when(twice, F.array_sort(
        F.transform("prints", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, k: F.coalesce(F.get("ranked", k)["h"] == x["h"], F.lit(False))
    df = df.withColumn("hits", F.array_sort(F.transform(
        F.filter("ranked", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("hits", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("hits", k + 1) - p, F.lit(WINDOW)))),
        F.lit(0), lambda a, x: a + x)
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
                     F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def fail_bits() -> Column:
    """The rules' failures as one integer, by rule order."""
    out = F.lit(0).cast("long")
    for rule, failed in RULES.items():
        out = out.bitwiseOR(F.when(F.expr(failed), F.lit(bit(rule))).otherwise(F.lit(0)).cast("long"))
    return out


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: measurements and ``fail_bits``."""
    return measure(docs, text).withColumn("fail_bits", fail_bits())


def passes(version: int) -> Column:
    """Whether a ledger row passes a policy version."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(version)).cast("long")) == 0


def kept_rows(docs: DataFrame, version: int = POLICY) -> DataFrame:
    """The rows of ``docs`` that pass a policy version, as they came.

    The verdict is made beside each row, so equal or null ids do no harm. It goes
    through ``explode``, past which the optimiser moves no filter: moved below the
    measurements, the filter would repeat them inside their own lambdas.
    """
    book = ledger(docs.select(F.struct(*docs.columns).alias("doc_id"), "text"))
    return book.withColumn("kept", F.explode(F.array(passes(version)))).where("kept").select("doc_id.*")


def ablations(book: DataFrame) -> DataFrame:
    """For each policy version and each of its rules: documents that fail the
    rule, that fail it alone (they come back without it), and all rejected.

    The ledger is first counted by ``fail_bits`` (at most 2**rules rows).
    """
    counts = book.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("docs"))
    rows = [(v, r, mask(v), bit(r)) for v in POLICIES for r in POLICIES[v]]
    table = book.sparkSession.createDataFrame(rows, "version int, rule string, mask long, rule_bit long")
    hit = lambda b: F.col("fail_bits").bitwiseAND(F.col(b))
    some = lambda c: F.coalesce(F.sum(F.when(c, F.col("docs"))), F.lit(0))
    return (table.join(counts, hit("mask") != 0, "left").groupBy("version", "rule")
            .agg(some(hit("rule_bit") != 0).alias("n_failed"),
                 some(hit("mask") == F.col("rule_bit")).alias("n_alone"),
                 some(F.col("docs").isNotNull()).alias("n_rejected")))
