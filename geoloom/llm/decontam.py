"""Benchmark passages in documents by spaced-seed hashing, in DataFrame
functions only.

Tokens are the runs of letters and digits of the lower-cased text. A mask
selects some positions of a window of ``SPAN`` tokens; the others may differ.
Each document window is hashed under every mask and joined with the
benchmark's windows. Every hit fixes an alignment of an item with the
document; along it equal tokens are counted over the whole item, so
substituted words cost their own place only. A document leaks an item if
``MIN_SHARE`` percent of the item's tokens are found so.

Items with fewer than ``SPAN`` tokens have no such window. They are found where
all their tokens occur in a row: one hash of the whole item is joined with the
document windows of each length that occurs among these items.

Hits are made distinct by (row, item, start) before any token is compared, and only
texts with a hit are tokenised again for that. The benchmark's hashes are
broadcast up to ``BROADCAST_ROWS`` rows of 20 bytes, which are counted first.
Beyond that a bitmap of them (of fixed size) is broadcast, and only (hash, row,
place) of windows that pass it are shuffled, never tokens.

Defined results: items without tokens and null texts match nothing; rows of one
id are judged each by its own tokens, and reported together under the id (a null
id too); repeated items match each by its own id; extra columns are not read;
empty tables give an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import runtime

SPAN = 11
#: Positions that count, for each mask.
MASKS = ((0, 1, 2, 4, 5, 7, 9, 10), (0, 1, 3, 4, 6, 7, 8, 10), (0, 2, 3, 5, 6, 8, 9, 10))
MIN_SHARE = 50
BROADCAST_ROWS = 500_000
SEED_BITS = 25


def _tokens(df: DataFrame, text_col: str, *names: Column) -> DataFrame:
    """(names..., tok, n): token hashes of the texts."""
    df = df.where(F.col(text_col).isNotNull()).select(*names, F.split(F.lower(F.col(text_col)), r"[^\p{L}\p{N}]+").alias("raw"))
    df = df.select(*[c for c in df.columns if c != "raw"], F.expr("transform(filter(raw, w -> w <> ''), w -> xxhash64(w))").alias("tok"))
    return df.withColumn("n", F.size("tok"))


def _seeds(df: DataFrame, keep: str, at: str, lengths: list[int] = []) -> DataFrame:
    """A row for each window and mask, and for each window of ``lengths`` tokens: (keep, at, seed)."""
    least = min([SPAN, *lengths])
    # a condition inside the generator, as a filter on n would be pushed down and tokenise every text twice
    windows = df.select(keep, "n", "tok", F.explode(F.expr(f"case when n >= {least} then sequence(0, n - {least}) end")).alias(at))
    masked = [F.xxhash64(F.lit(k), *[F.expr(f"tok[{at} + {p}]") for p in mask]) for k, mask in enumerate(MASKS)]
    if lengths:
        exact = [(m, F.xxhash64(F.lit(len(MASKS) + m), *[F.expr(f"tok[{at} + {p}]") for p in range(m)])) for m in lengths]
        guarded = [F.when(F.expr(f"{at} + {m} <= n"), h) for m, h in [(SPAN, h) for h in masked] + exact]
        hashes = F.array_compact(F.array(*guarded))
    else:
        hashes = F.array(*masked)
    return windows.select(keep, at, F.explode(hashes).alias("seed"))


def _whole_seeds(items: DataFrame, keep: str, at: str, lengths: list[int]) -> DataFrame:
    """A row for each short item: (keep, at, seed), with the hash of all its tokens."""
    seed = F.coalesce(*[F.when(F.col("n") == m, F.xxhash64(F.lit(len(MASKS) + m), *[F.expr(f"tok[{p}]") for p in range(m)])) for m in lengths])
    return items.where(F.col("n").isin(lengths)).select(keep, F.lit(0).alias(at), seed.alias("seed"))


def alignments(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(row, doc_id, item_id, item_n, start, matched): every alignment of an item with a row that a
    hash proposes, and the item's tokens found along it."""
    items = runtime.written(_tokens(benchmark, item_text, F.col(item_col).alias("item_id"), F.monotonically_increasing_id().alias("item")), "leak-items")
    lengths = sorted(r.n for r in items.where(f"n between 1 and {SPAN - 1}").select("n").distinct().collect())
    grams = _seeds(items, "item", "item_at")
    if lengths:
        grams = grams.unionByName(_whole_seeds(items, "item", "item_at", lengths))
    grams = runtime.written(grams, "leak-hashes")
    keyed = docs.select(runtime.row_key(id_col, text_col).alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    windows = _seeds(_tokens(keyed, "text", F.col("row")), "row", "doc_at", lengths)
    if grams.count() <= BROADCAST_ROWS:
        grams = F.broadcast(grams)
    else:
        windows, _ = runtime.split_by_bitmap(windows, "seed", runtime.bitmap(grams, "seed", SEED_BITS), SEED_BITS)
    hits = windows.join(grams, "seed").select("row", "item", (F.col("doc_at") - F.col("item_at")).alias("start")).distinct()
    hits = runtime.written(hits, "leak-hits")
    some, _ = runtime.split_by_bitmap(keyed, "row", runtime.bitmap(hits, "row"))
    aimed = hits.withColumnRenamed("row", "hit_row").join(items.select("item", "item_id", F.col("tok").alias("item_tok"), F.col("n").alias("item_n")), "item")
    both = aimed.join(_tokens(some, "text", F.col("row"), F.col("doc_id")), F.col("hit_row") == F.col("row"))
    same = "size(filter(sequence(greatest(0, -start), least(item_n, n - start) - 1), k -> tok[start + k] = item_tok[k]))"
    return both.select("row", "doc_id", "item_id", "item_n", "start", F.expr(same).alias("matched"))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_matched, n_tokens, at): the leaked items of each document.

    ``at`` is the token of the document where the best alignment of the item
    begins (negative if the item's first tokens lie before the document).
    """
    hits = alignments(docs, benchmark, id_col, text_col, item_col, item_text)
    best = hits.groupBy("doc_id", "item_id", "item_n").agg(F.max("matched").alias("n_matched"), F.min(F.struct((-F.col("matched")).alias("m"), "start")).alias("best"))
    return best.where(f"100 * n_matched >= {MIN_SHARE} * item_n").select("doc_id", "item_id", F.col("n_matched").cast("long"), F.col("item_n").cast("long").alias("n_tokens"), F.col("best.start").cast("long").alias("at"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that leak no item, with their own columns."""
    return runtime.without_rows(docs, alignments(docs, benchmark).where(f"100 * matched >= {MIN_SHARE} * item_n").select(F.col("row").alias("__row")))


def _sql_seeds(relation: str) -> str:
    keys = ", ".join("[" + f"'{k}'" + "".join(f", tok[i + {p + 1}]" for p in mask) + "]" for k, mask in enumerate(MASKS))
    return f"select *, unnest([{keys}]) as seed from (select *, unnest(range(0, n - {SPAN - 1})) as i from {relation})"


#: DuckDB SQL of ``leaks``, for items of ``SPAN`` tokens and more, over ``{documents}`` and ``benchmark``.
SQL = rf"""
with d as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{{{L}}}}\p{{{{N}}}}]+'), lambda w: w <> '') as tok from {{documents}} where text is not null),
b as (select item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{{{L}}}}\p{{{{N}}}}]+'), lambda w: w <> '') as tok from benchmark where text is not null),
dn as (select *, len(tok) as n from d where len(tok) >= {SPAN}), bn as (select *, len(tok) as n from b where len(tok) >= {SPAN}),
ds as ({_sql_seeds("dn")}), bs as ({_sql_seeds("bn")}),
h as (select distinct ds.doc_id, bs.item_id, ds.n, bs.n as item_n, ds.i - bs.i as start, ds.tok as tok, bs.tok as item_tok from ds join bs using (seed)),
v as (select doc_id, item_id, item_n, start, len(list_filter(range(greatest(0, -start), least(item_n, n - start)), lambda k: tok[start + k + 1] = item_tok[k + 1])) as matched from h)
select doc_id, item_id, max(matched)::bigint as n_matched, item_n::bigint as n_tokens, (min({{{{'m': -matched, 's': start}}}}))['s']::bigint as at
from v group by doc_id, item_id, item_n having 100 * max(matched) >= {MIN_SHARE} * item_n
"""
