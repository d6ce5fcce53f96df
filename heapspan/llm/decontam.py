"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

Tokens are runs of letters and digits, lower-cased. An item with n >= `least` tokens contaminates a text if W = min(`window`, n)
of its tokens in a row stand in the text in the same order with at most W // 10 of them replaced. Seeds are the hashes
of tokens under fixed masks, which ignore some positions; together the masks meet every such overlap (for each W from 8 to 20
and every choice of replaced tokens some mask lies on kept ones only; the tests try them all), so nothing is lost.

A Bloom filter of the test items' seeds, a literal with 16 bits a seed up to `words` 64-bit words, drops nearly all of a text's
positions before anything is exploded (with more than 4 * words seeds a growing share passes, and the result stays the same).
What passes takes along the tokens around it (as hashes) and is joined to the items' seeds on the exact hash; a seed holds the
tokens around it too, never its whole item, so a row has some hundred bytes whatever the item's length. Then each distinct
alignment is verified over all windows that hold the seed. Texts are read once and never shuffled. Seeds are broadcast only up to
`small` of them, that is 60 MB; beyond, the joins shuffle, and a frequent seed is split by AQE as a skewed join.

Cases: null and empty texts are clean; null ids are kept apart by text; repeated rows get the same result; an empty
table gives an empty result, empty items find nothing; items with fewer than `least` tokens are no evidence and are not
searched; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kept positions; 2 and 5 are ignored in a span of 8.
MASKS = ((0, 1, 2, 3, 4, 6, 7), (0, 1, 3, 4, 5, 6, 7))
SPAN, WINDOW, LEAST = 8, 20, 8

_TOKENS = r"transform(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+', 0), t -> xxhash64(t))"
_COUNT = "size(tokens)"


def _seed(mask: int, at: str) -> str:
    return f"xxhash64({mask}, {', '.join(f'get(tokens, {at} + {k})' for k in MASKS[mask])})"


def _seeds(mask: int) -> str:
    """SQL: the seed of every position, in order."""
    return f"IF({_COUNT} < {SPAN}, cast(array() as array<bigint>), transform(sequence(0, {_COUNT} - {SPAN}), i -> {_seed(mask, 'i')}))"


def _seed_at(at: str) -> str:
    """SQL: the seed under the row's mask at a position."""
    return "CASE mask " + " ".join(f"WHEN {m} THEN {_seed(m, at)}" for m in range(len(MASKS))) + " END"


#: Shifts of a seed that choose its three bits in a word of the filter.
_SHIFTS = (32, 40, 48)


def _bits(seed: str) -> str:
    return "(" + " | ".join(f"shiftleft(1L, cast(shiftrightunsigned({seed}, {n}) & 63L as int))" for n in _SHIFTS) + ")"


def tokens(df: DataFrame, text_col: str) -> DataFrame:
    return df.withColumn("tokens", F.expr(_TOKENS.format(f"coalesce(`{text_col}`, '')")))


def _long(x: int) -> str:
    return f"{x}L" if x > -(2**63) else "(-9223372036854775807L - 1L)"


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, least: int = LEAST, words: int = 1 << 15, small: int = 1 << 17) -> DataFrame:
    """Distinct (id, text_hash, item, at, best): items that contaminate a text, `at` the alignment (text position of the
    item's first token, which may be negative), best the largest number of equal tokens in a window."""
    tests = tokens(items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")), "text").where(f"{_COUNT} >= {least}").select("item", F.col("tokens").alias("theirs")).distinct()
    seeds = tests.withColumnRenamed("theirs", "tokens").selectExpr("item", "tokens", "size(tokens) as n_theirs", f"inline(flatten(array({', '.join(f'transform({_seeds(m)}, (s, i) -> struct(s as seed, i as there))' for m in range(len(MASKS)))})))")
    seeds = seeds.selectExpr("item", "n_theirs", "seed", "there", f"greatest(there - {window - 1}, 0) as theirs_from", f"slice(tokens, greatest(there - {window - 1}, 0) + 1, {2 * window + SPAN}) as theirs")
    n = seeds.count()
    slots = min(words, max(64, 1 << (n // 4).bit_length()))
    slot = f"cast(seed & {slots - 1}L as int)"
    filled = {r.slot: r.bits for r in seeds.groupBy(F.expr(slot).alias("slot")).agg(F.expr(f"bit_or({_bits('seed')})").alias("bits")).collect()}
    literal = f"array({', '.join(_long(filled.get(i, 0)) for i in range(slots))})"
    # bit by bit, as nearly all positions fail at the first; positions and not seeds are kept, so nothing is allocated for them
    held = " AND ".join(f"bit_get(element_at(filter_words, {slot} + 1), cast(shiftrightunsigned(seed, {k}) & 63L as int)) = 1" for k in _SHIFTS).replace("seed", "s")
    read = tokens(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text").selectExpr("id", "xxhash64(text) as text_hash", "tokens", f"{literal} as filter_words")  # folded into what uses it
    passing = ", ".join(f"transform(filter(transform({_seeds(m)}, (s, i) -> IF({held}, i, -1)), x -> x >= 0), x -> struct({m} as mask, x as here))" for m in range(len(MASKS)))
    near = f"slice(tokens, greatest(here - {window - 1}, 0) + 1, {2 * window + SPAN})"
    hits = read.where(f"{_COUNT} >= {SPAN}").selectExpr("id", "text_hash", "tokens", f"inline(concat({passing}))").selectExpr("id", "text_hash", f"{_seed_at('here')} as seed", "here", f"greatest(here - {window - 1}, 0) as ours_from", f"{near} as ours")
    listed = F.broadcast(seeds) if n <= small else seeds
    met = hits.join(listed, "seed").selectExpr("id", "text_hash", "item", "here - there as at", "here", "there", "ours", "ours_from", "theirs", "theirs_from", "n_theirs")
    # positions of the item from which a window that holds the seed may reach, and whether they are equal
    length = f"least({window}, n_theirs)"
    equal = met.withColumn("w", F.expr(length)).withColumn("low", F.expr("greatest(there - w + 1, 0, -at)")).withColumn("same", F.expr("transform(sequence(low, least(there + w, n_theirs) - 1), q -> IF(get(ours, at + q - ours_from) <=> get(theirs, q - theirs_from) AND get(ours, at + q - ours_from) is not null, 1, 0))"))
    tail = equal.withColumn("room", F.expr("size(filter(transform(sequence(low, low + size(same) - 1), q -> get(ours, at + q - ours_from)), x -> x is not null))"))
    best = "array_max(transform(sequence(0, room - w), s -> aggregate(slice(same, s + 1, w), 0, (a, x) -> a + x)))"
    verified = tail.where("room >= w").withColumn("best", F.expr(best)).where("best >= w - w div 10")
    return verified.groupBy("id", "text_hash", "item", "at").agg(F.max("best").alias("best"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, contaminated, n_items (that contaminate it), first_item (the smallest), best (most equal tokens in a window; 0 if clean) of each row."""
    found = overlaps(docs, items, id_col, text_col, **options)
    each = found.groupBy("id", "text_hash", "item").agg(F.max("best").alias("best")).groupBy("id", "text_hash").agg(F.count("*").alias("n_items"), F.min("item").alias("first_item"), F.max("best").alias("best"))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    each = each.withColumnRenamed("id", "known").withColumnRenamed("text_hash", "known_hash")
    out = rows.join(each, F.col("id").eqNullSafe(F.col("known")) & (F.col("text_hash") == F.col("known_hash")), "left")
    return out.select(F.col("id").alias(id_col), F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), "first_item", F.coalesce("best", F.lit(0)).alias("best"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns, that no item contaminates."""
    found = overlaps(docs, items, id_col, text_col, **options).select("id", "text_hash").distinct().alias("f")
    return docs.alias("d").join(found, F.col(f"d.{id_col}").eqNullSafe(F.col("f.id")) & (F.xxhash64(F.col(f"d.{text_col}")) == F.col("f.text_hash")), "left_anti")


ORACLE = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') as t from documents),
b as (select row_number() over () as i, item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') as t from benchmark),
items as (select i, item_id, len(t) as n, least(20, len(t)) as w from b where len(t) >= 8),
dw as (select r, unnest(t) as x, unnest(range(len(t))) as p, len(t) as n_doc from d),
bw as (select i, unnest(t) as x, unnest(range(len(t))) as q from b where len(t) >= 8),
m as (select r, i, p - q as gap, list(q order by q) as qs, any_value(n_doc) as n_doc from dw join bw using (x) group by r, i, p - q having count(*) >= 8),
c as (select r, item_id, qs, w, unnest(qs) as q, n, n_doc, gap from m join items using (i) where len(qs) >= w - w // 10),
s as (select r, item_id, w, qs, least(q, n - w, n_doc - gap - w) as s, gap from c),
v as (select r, item_id, max(len(list_filter(qs, lambda x: x >= s and x < s + w))) as best from s where s >= 0 and s >= -gap
  and len(list_filter(qs, lambda x: x >= s and x < s + w)) >= w - w // 10 group by r, item_id),
e as (select r, count(*) as n_items, min(item_id) as first_item, max(best) as best from v group by r)
select doc_id, n_items is not null as contaminated, coalesce(n_items, 0) as n_items, first_item, coalesce(best, 0) as best from d left join e using (r)
"""
