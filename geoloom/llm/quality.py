"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document. The ledger keeps the measurements
and one long whose bit k is set if rule k failed. A policy is a versioned
mask over the bits: keeping, rejecting and ablating are bitwise operations on
the ledger, with no second look at the texts.

Repeated three-word windows are found inside the row: each window becomes a
long whose high bits are a hash and whose low bits are its position, the
longs are sorted, and equal neighbours are compared by their words. Should a
text have two different windows under one hash, that text alone is measured
again by sorting the windows themselves.

Defined results: a null or empty text has no words, all counts zero, and
fails ``few_words``; each input row gives one row, repeated ids included;
extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import runtime

#: The characters themselves: SQL literals have their own escapes.
_WS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rule:
    """A named condition of failure over the measurements."""

    name: str
    fails: str


#: Bit k of the ledger is RULES[k]. Only append; policies name bits by rule.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "100 * n_symbols > 10 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 70 * n_lines"),
    Rule("some_repetition", "100 * n_repeat_words > 20 * n_words"),
)
#: Version -> rules that reject. Rules outside a policy are only recorded.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "short_words", "long_words", "repeated_lines"),
    "strict": tuple(r.name for r in RULES),
}
CURRENT = "v1"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def mask(policy: str) -> int:
    return sum(1 << k for k, r in enumerate(RULES) if r.name in POLICIES[policy])


def _repeat_words(df: DataFrame) -> DataFrame:
    """Adds q_repeat from the words array q_words."""
    df = df.withColumn("q_n", F.size("q_words")).withColumn("q_bits", F.expr("cast(ceil(log2(q_n + 2)) as int)"))
    packed = "transform(sequence(0, q_n - 3), i -> shiftleft(xxhash64(q_words[i], q_words[i + 1], q_words[i + 2]), q_bits) | cast(i as bigint))"
    df = df.withColumn("q_sorted", F.expr(f"case when q_n >= 4 then sort_array({packed}) end"))
    # neighbours with equal hashes: their indexes in the sorted array
    df = df.withColumn("q_same", F.expr("case when q_n >= 4 then filter(sequence(1, q_n - 3), i -> shiftright(q_sorted[i], q_bits) = shiftright(q_sorted[i - 1], q_bits)) end"))
    at = "cast(q_sorted[i{}] & (shiftleft(1L, q_bits) - 1L) as int)"
    p, q = at.format(""), at.format(" - 1")
    equal = " and ".join(f"q_words[{p} + {k}] = q_words[{q} + {k}]" for k in range(3))
    df = df.withColumn("q_clash", F.expr(f"coalesce(exists(q_same, i -> not ({equal})), false)"))
    near = f"flatten(transform(q_same, i -> array({p}, {q})))"
    exact = (
        "flatten(transform(filter(aggregate(sort_array(transform(sequence(0, q_n - 3), i -> struct(struct(q_words[i] as a, q_words[i + 1] as b, q_words[i + 2] as c) as w, i as i))),"
        " cast(array() as array<struct<w:struct<a:string,b:string,c:string>,first:int,i:int>>),"
        " (acc, x) -> concat(acc, array(struct(x.w as w, case when size(acc) > 0 and acc[size(acc) - 1].w = x.w then acc[size(acc) - 1].i else -1 end as first, x.i as i)))), x -> x.first >= 0), x -> array(x.first, x.i)))"
    )
    df = df.withColumn("q_at", F.expr(f"case when size(q_same) > 0 then sort_array(array_distinct(case when q_clash then {exact} else {near} end)) end"))
    covered = "aggregate(q_at, struct(0L as n, -3 as last), (s, i) -> struct(s.n + least(3, i - s.last) as n, i as last), s -> s.n)"
    return df.withColumn("q_repeat", F.expr(f"case when q_at is null then 0L else {covered} end"))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, measurements, n_lines, row_key, fail_bits), one row per input row."""
    df = docs.select(F.col(id_col).alias("doc_id"), runtime.row_key(id_col, text_col).alias("row_key"), F.coalesce(F.col(text_col), F.lit("")).alias("q_text"))
    df = df.withColumn("q_words", F.expr(f"filter(split(q_text, '[{_WS}]+'), w -> w <> '')"))
    df = _repeat_words(df)
    df = df.withColumn("q_lines", F.expr(f"filter(split(q_text, '\\n'), l -> l rlike '[^{_WS}]')"))
    measured = df.select(
        "doc_id",
        F.col("q_n").cast("long").alias("n_words"),
        F.length(F.array_join("q_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("q_text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long").alias("n_dup_lines"),
        F.col("q_repeat").alias("n_repeat_words"),
        F.size("q_lines").cast("long").alias("n_lines"),
        "row_key",
    )
    bits = " | ".join(f"(case when {r.fails} then {1 << k}L else 0L end)" for k, r in enumerate(RULES))
    return measured.withColumn("fail_bits", F.expr(bits))


def failed(policy: str) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) != 0


def stored(docs: DataFrame) -> DataFrame:
    """The ledger written once. Policies and ablations read this small table;
    a filter on the unwritten ledger would be pushed down and measure again."""
    return runtime.written(ledger(docs), "quality-ledger")


def judged(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The stored ledger with base_failed and the policy's verdict."""
    return stored(docs).withColumn("base_failed", failed("base")).withColumn("kept", ~failed("base") & ~failed(policy))


def ablation(book: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents that fail it, and those only it rejects.

    The ledger is first reduced to counts of bit patterns (at most 2**rules
    rows), by partial aggregation.
    """
    m = mask(policy)
    counts = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, r in enumerate(RULES) if m >> k & 1])
    return (
        counts.select(F.explode(rules).alias("r"), "bits", "n")
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(F.sum(F.expr("case when bits & r.bit <> 0 then n else 0 end")).alias("n_failed"), F.sum(F.expr("case when bits = r.bit then n else 0 end")).alias("n_only"))
    )


#: DuckDB SQL of the judged ledger over ``documents`` (or another relation).
SQL = r"""
with t as (select doc_id, coalesce(text, '') as text from {documents}),
w as (select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines from t),
g as (select doc_id, unnest(list_transform(range(1, len(words) - 1), lambda i: words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2])) as gram,
  unnest(range(1, len(words) - 1)) as i from w),
r as (select doc_id, i, count(*) over (partition by doc_id, gram) as n from g),
p as (select doc_id, count(distinct k) as n_repeat_words from (select doc_id, unnest(range(i, i + 3)) as k from r where n > 1) group by doc_id),
c as (select w.*, coalesce(p.n_repeat_words, 0) as n_repeat_words from w left join p using (doc_id)),
m as (select doc_id, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
  (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, len(lines)::bigint as n_lines from c),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or 100 * n_symbols > 10 * n_words or word_chars < 2 * n_words or word_chars > 20 * n_words or 100 * n_dup_lines > 70 * n_lines) as kept
from b
"""
