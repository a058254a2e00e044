"""Quality rules as a bitmask ledger (op 8), with DataFrame functions only.

Every rule is evaluated once per document. The ledger keeps what was measured and one long whose bit k is
set where rule k fails. A policy is a versioned set of rules, hence a mask: a document is kept if
``failures & mask == 0``. Ablations (what would each rule alone change?) are sums over bits of the
ledger; no text is read again. No stage shuffles texts, so a hot source or long document costs its own size.

Defined cases: a null text counts as empty, an empty one has no words and fails ``few_words``;
repeated rows are judged one by one; null ids pass through; other columns are ignored by the ledger
and kept by ``keep``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let, words

SYMBOLS = "#*$%&|<>"
DIGITS = "0123456789"


@dataclass(frozen=True)
class Rule:
    """``fails`` takes the struct of measurements."""

    name: str
    fails: Callable[[Column], Column]


#: Bit k of ``failures`` belongs to the k-th rule. New rules go to the end, so that old ledgers stay readable.
RULES = (
    Rule("few_words", lambda m: m["n_words"] < 50),
    Rule("repeated_windows", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    Rule("symbols", lambda m: 4 * m["n_symbols"] > m["n_words"]),
    Rule("short_words", lambda m: m["word_chars"] < 2 * m["n_words"]),
    Rule("long_words", lambda m: m["word_chars"] > 20 * m["n_words"]),
    Rule("duplicate_lines", lambda m: (m["n_dup_lines"] > 2) & (100 * m["n_dup_lines"] > 30 * m["n_lines"])),  # a share of three lines says nothing
    Rule("digits", lambda m: 5 * m["n_digits"] > m["word_chars"]),
    Rule("bullets", lambda m: 100 * m["n_bullet_lines"] > 90 * m["n_lines"]),
    Rule("ellipses", lambda m: 100 * m["n_ellipsis_lines"] > 30 * m["n_lines"]),
    Rule("many_words", lambda m: m["n_words"] > 100000),
    Rule("braces", lambda m: m["n_braces"] > 0),
)
BIT = {r.name: 1 << k for k, r in enumerate(RULES)}
BASE = ("few_words", "repeated_windows")

#: version -> rules that reject. Rules outside a policy are still measured.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "prose-1": (*BASE, "symbols", "short_words", "long_words", "duplicate_lines", "digits", "bullets", "ellipses"),
    "strict-1": tuple(BIT),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_digits", "n_bullet_lines", "n_ellipsis_lines", "n_braces")


def mask(policy: str) -> int:
    return sum(BIT[r] for r in POLICIES[policy])


def _repeat_words(w: Column) -> Column:
    """Words inside three-word windows that occur twice or more: sort the windows' hashes, look at neighbours."""

    def covered(pos: Column) -> Column:
        after = F.slice(pos, 2, F.greatest(F.size(pos) - 1, F.lit(0)))
        return F.aggregate(F.zip_with(pos, after, lambda p, q: F.least(F.lit(3), F.coalesce(q - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)

    def neighbours(win: Column) -> Column:
        return F.zip_with(win, F.slice(win, 2, F.size(win)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))

    def repeated(win: Column) -> Column:
        return F.sort_array(F.array_distinct(F.flatten(F.filter(neighbours(win), lambda x: x.isNotNull()))))

    def triples(h: Column) -> Column:
        two = F.zip_with(h, F.slice(h, 2, F.size(h)), lambda a, b: F.xxhash64(a, b))
        three = F.zip_with(two, F.slice(h, 3, F.size(h)), lambda a, b: F.xxhash64(a, b))
        return F.slice(three, 1, F.size(h) - 2)

    def count(hs: Column) -> Column:
        win = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), 0).otherwise(let(repeated(win), covered))

    hashes = F.transform(w, lambda x: F.xxhash64(x))
    return F.when(F.size(w) < 4, 0).otherwise(let(hashes, lambda h: let(triples(h), count)))


def measured(text: Column) -> Column:
    """A struct of MEASURES, all long."""
    text = F.coalesce(text, F.lit(""))
    length = F.length(text)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def all_of(w: Column, own: Column) -> Column:
        values = {
            "n_words": F.size(w),
            "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")),
            "n_symbols": length - F.length(F.translate(text, SYMBOLS, "")),
            "n_dup_lines": F.size(own) - F.size(F.array_distinct(own)),
            "n_repeat_words": _repeat_words(w),
            "n_lines": F.size(own),
            "n_digits": length - F.length(F.translate(text, DIGITS, "")),
            "n_bullet_lines": F.size(F.filter(own, lambda x: x.rlike(r"^[\x20\x09]*[-*•]"))),
            "n_ellipsis_lines": F.size(F.filter(own, lambda x: x.endswith("...") | x.endswith("…"))),
            "n_braces": length - F.length(F.translate(text, "{}", "")),
        }
        return F.struct(*[values[m].cast("long").alias(m) for m in MEASURES])

    return let(words(text), lambda w: let(lines, lambda own: all_of(w, own)))


def failures(measures: Column) -> Column:
    """A bit for each rule that fails, as long."""
    return reduce(Column.bitwiseOR, [F.when(r.fails(measures), BIT[r.name]).otherwise(0) for r in RULES]).cast("long")


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and ``failures`` (long): a bit for each rule that fails."""
    return docs.select("doc_id", measured(F.col("text")).alias("m")).select("doc_id", "m.*", failures(F.col("m")).alias("failures"))


def apply_policy(found: DataFrame, policy: str) -> DataFrame:
    """``found`` (a ledger) with ``base_failed`` and ``kept``."""
    hit = lambda name: F.col("failures").bitwiseAND(F.lit(mask(name))) != 0
    return found.withColumn("base_failed", hit("base")).withColumn("kept", ~(hit("base") | hit(policy)))


def ablations(found: DataFrame, policies: tuple[str, ...] = tuple(POLICIES)) -> DataFrame:
    """policy, rule, n_fail (documents the rule rejects), n_only (that no other rule of the policy rejects)."""
    f = F.col("failures")
    wanted = [(p, r) for p in policies for r in POLICIES[p]]
    sums = [F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.sum((f.bitwiseAND(BIT[r]) != 0).cast("long")).alias("n_fail"), F.sum((f.bitwiseAND(mask(p)) == BIT[r]).cast("long")).alias("n_only")) for p, r in wanted]
    rows = found.agg(F.array(*sums).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")
    return rows.select("policy", "rule", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_fail", "n_only")])


def keep(docs: DataFrame, policy: str = "prose-1") -> DataFrame:
    """The rows of ``docs`` whose failure bits have none of the policy's, with all their columns."""
    m, bits = fresh(docs, "quality_measured"), fresh(docs, "quality_failures")
    judged = docs.withColumn(m, measured(F.col("text"))).withColumn(bits, failures(F.col(m)))
    return judged.where(F.col(bits).bitwiseAND(F.lit(mask(policy))) == 0).drop(m, bits)
