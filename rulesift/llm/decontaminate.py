"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

Texts are lower-cased and split at blanks.  A fixed mask reads some words of a
window and ignores the others, so that a window still hits after a word in a
gap was replaced:

1. Each mask's hash of every window of every text is joined with those of the items.
   Texts are not shuffled: the items' windows go to the tasks if the benchmark
   has at most ``BROADCAST_WORDS`` words (checked), else both sides are joined
   by a shuffle of hashes.
2. A hit gives a diagonal (place in the text minus place in the item).  Along
   each diagonal the text's words are compared with the whole item, word by word.
3. An item is found in a text if the words matched on all its diagonals cover
   at least 80 % of the item; replaced words cost their place, and words put in
   or left out continue on another diagonal.

Which masks an item needs depends on its own length alone (``masks_of``): ``MASKS`` hit every
pattern of replaced words within the bound from 13 words on; shorter items get lighter masks, chosen
so that every allowed pattern of replaced words leaves a window unharmed; below five words no
word may differ, and the whole item is the mask.  Texts are hashed with the masks that some item
needs, and an item joins by its own masks only, so no item changes another's result.

Defined cases: null and empty texts and items give nothing; rows equal in id and
text count once; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulesift.session import materialize

#: Fixed masks: 1 reads a word, 0 ignores it.
MASKS = ("111101", "1101011", "1011101")
#: Items from this length on need no other masks.
LONG = 13
#: Words that the masks of shorter items read, and their longest span.
LIGHT, SPAN = 4, 8
PERCENT = 80
BROADCAST_WORDS = 100_000


def hits(mask: str, n: int, replaced: set[int]) -> bool:
    """Whether some window of the mask in n words reads none of the replaced ones."""
    return any(all(x == "0" or at + k not in replaced for k, x in enumerate(mask)) for at in range(n - len(mask) + 1))


@lru_cache
def masks_of(n: int) -> tuple[str, ...]:
    """The masks of an item of n words: of those that read ``LIGHT`` words, the one that hits the most
    patterns not hit yet goes next."""
    if n >= LONG:
        return MASKS
    most = n * (100 - PERCENT) // 100
    if not most:
        return ("1" * n,)
    chosen = [m for m in MASKS if len(m) <= n]
    patterns = [set(x) for x in combinations(range(n), most)]
    light = ["".join("1" if k in (0, size - 1, *inner) else "0" for k in range(size))
             for size in range(LIGHT, min(n, SPAN) + 1) for inner in combinations(range(1, size - 1), LIGHT - 2)]
    while left := [p for p in patterns if not any(hits(m, n, p) for m in chosen)]:
        chosen.append(max(light, key=lambda m: sum(hits(m, n, p) for p in left)))
    return tuple(chosen)


def _words(table: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """(name, row, words): hashes of the words in order; ``row`` tells rows of one id apart."""
    words = F.transform(F.array_remove(F.split(F.lower(text_col), r"[\x20\x09-\x0D]+"), ""), lambda w: F.xxhash64(w))
    return (table.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias(name), F.xxhash64(text_col).alias("row"), words.alias("words"))
            .where(F.size("words") > 0))


def _seeds(mask: str) -> str:
    """SQL for the hashes of a mask's windows over ``words``, in order."""
    reads = ", ".join(f"get(words, i + {k})" for k, x in enumerate(mask) if x == "1")
    return f"transform(sequence(0, size(words) - {len(mask)}), i -> xxhash64('{mask}', {reads}))"


def _windows(words: DataFrame, masks: list[str], place: str, lengths: dict[str, list[int]] | None = None) -> DataFrame:
    """One row per mask and window: its place and hash, with the columns of ``words``; ``lengths``:
    the sizes of ``words`` that a mask is for (all, if not given)."""
    fits = {m: f"size(words) >= {len(m)}" + (f" AND size(words) IN ({', '.join(map(str, lengths[m]))})" if lengths else "") for m in masks}
    arrays = ", ".join(f"if({fits[m]}, {_seeds(m)}, array())" for m in masks)
    by_mask = words.withColumn("seeds", F.explode(F.expr(f"array({arrays})")))
    return by_mask.select(*words.columns, F.posexplode("seeds").alias(place, "seed"))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item, matched, n_words) of every item found in a text: the item's words that match, and all its words."""
    items = _words(benchmark, item_col, item_text_col, "item").select("item", "words").distinct()
    items = items.select(F.monotonically_increasing_id().alias("k"), "item", "words")
    items = materialize(items, "items")  # numbered once
    sizes = [r[0] for r in items.select(F.size("words")).distinct().collect()]  # as many as there are lengths
    lengths: dict[str, list[int]] = {}
    for n in sorted(sizes):
        for mask in masks_of(n):
            lengths.setdefault(mask, []).append(n)
    if not lengths:
        lengths = {MASKS[0]: [0]}  # no item: nothing is found
    masks = list(lengths)
    small = items.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0] <= BROADCAST_WORDS
    to_tasks = F.broadcast if small else (lambda df: df)

    seeds = _windows(items.select("k", "words"), masks, "at", lengths).select("k", "at", "seed", F.size("words").alias("n")).distinct()
    words = _words(docs, id_col, text_col, "id")
    part = F.expr("slice(words, greatest(diagonal, 0) + 1, n)").alias("part")
    if small:  # the words wait beside their windows, and only those of hits go on
        found = _windows(words, masks, "place").join(F.broadcast(seeds), "seed").withColumn("diagonal", F.expr("place - at"))
        found = found.select("id", "row", "k", "diagonal", part).groupBy("id", "row", "k", "diagonal").agg(F.first("part").alias("part"))
    else:  # hashes alone are shuffled; texts that are hit are read again
        windows = _windows(words, masks, "place").select("id", "row", "place", "seed")
        found = windows.join(seeds, "seed").select("id", "row", "k", "n", F.expr("place - at AS diagonal")).distinct().alias("h")
        found = found.join(words.distinct().alias("w"), F.expr("h.id <=> w.id AND h.row = w.row")).select("h.id", "h.row", "k", "diagonal", part)
    compared = found.join(to_tasks(items), "k").select(
        "id", "row", "item", F.size("words").alias("n"), F.col("k"),
        F.explode(F.expr("filter(transform(words, (w, i) -> if(w = get(part, i + least(diagonal, 0)), i, null)), i -> i is not null)")).alias("at"))
    matched = compared.distinct().groupBy("id", "row", "item", "k", "n").agg(F.count("*").alias("matched"))
    enough = matched.where(100 * F.col("matched") >= PERCENT * F.col("n"))
    best = enough.groupBy("id", "item").agg(F.max(F.struct("matched", F.col("n").cast("long").alias("n"))).alias("best"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "best.matched", F.col("best.n").alias("n_words"))
