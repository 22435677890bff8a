"""Line dedup by pairwise alignment: common blocks of lines are deleted from the later document.

Lines are compared by the words in them, so that white space at their ends does
not matter; blank lines carry no evidence. The evidence is rare by make: a key is
the hash of the shortest run of lines from (or up to) a line that has
`block_words` words, one long line or several short ones. For each key that
several documents hold, the first document holding it is paired with each of the
others: one pair for each further holder, never all pairs of the holders. As
every line of a common block lies in such a run inside the block, and the first
holder of the run has the run, no block goes without a pair, and as the first
holder keeps it, nothing is lost.

The runs of a pair are aligned with patience diff: runs that are unique in both
texts and in increasing order are fixed, gaps between them are aligned again (by
equal occurrences where nothing is unique), and matches are extended to equal
neighbours. Aligned blocks have at least `block_words` words and are deleted from
the later document. Runs that the alignment leaves because they stand in another
order, or stand in the later document more often, are dealt to further increasing
alignments all at once, in one sorted pass, until none is left.

Documents are ordered by id, nulls last, then by a hash of the text.

Defined results: rows that repeat an id and text are one document and all get
its result; null and empty texts stay as they are; a text of which every line
is deleted becomes empty; blank lines go with the block that encloses them; an
empty table gives an empty table; all columns of the input stay, whatever their
names; a pair of very long texts takes one alignment and one sorted pass.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colligo.llm.common import hot_join, staged, text_or_empty
from colligo.llm.pii import marked, slot_bits

SPACES = r"[\x20\x09-\x0D]+"
BLOCK_WORDS = 16
#: Pairs of one first document that a task aligns together, about.
FIRST_ROWS = 512
#: Hash values by which documents are held against those of a join before they are shuffled for it: 512 KB of bits, whatever their number.
SLOTS = 1 << 22


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs (sorted by first) with increasing seconds."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, b) in enumerate(pairs):
        i = bisect_left(tops, b)
        back.append(at[i - 1] if i else -1)
        if i == len(tops):
            tops.append(b)
            at.append(k)
        else:
            tops[i], at[i] = b, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched positions of two hash sequences, increasing in both."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        na, nb = Counter(a[a0:a1]), Counter(b[b0:b1])
        once = {h: j for j, h in enumerate(b[b0:b1], b0) if nb[h] == 1 and na.get(h) == 1}
        fixed = increasing([(i, once[h]) for i, h in enumerate(a[a0:a1], a0) if h in once])
        if not fixed:
            seen: Counter = Counter()
            where = {}
            for j, h in enumerate(b[b0:b1], b0):
                seen[h] += 1
                where[h, seen[h]] = j
            seen.clear()
            both = []
            for i, h in enumerate(a[a0:a1], a0):
                seen[h] += 1
                if (h, seen[h]) in where:
                    both.append((i, where[h, seen[h]]))
            out += increasing(both)
            continue
        edges = [(a0 - 1, b0 - 1), *fixed, (a1, b1)]
        out += fixed
        work += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def runs(hashes: list[int], words: list[int], block_words: int) -> tuple[list[int | None], list[int]]:
    """For each line the key of the shortest run from it that has block_words words (None past the last), and the run's size."""
    keys: list[int | None] = []
    sizes = []
    end = total = 0
    for at in range(len(hashes)):
        while end < len(hashes) and total < block_words:
            total += words[end]
            end += 1
        keys.append(hash(tuple(hashes[at:end])) if total >= block_words else None)
        sizes.append(end - at)
        total -= words[at]
    return keys, sizes


def keys_of(hashes: list[int], words: list[int], block_words: int) -> set[int]:
    """Keys of the runs from every line and of those up to every line."""
    out = set(runs(hashes, words, block_words)[0])
    end = total = 0
    back, count = hashes[::-1], words[::-1]
    for at in range(len(back)):
        while end < len(back) and total < block_words:
            total += count[end]
            end += 1
        if total >= block_words:
            out.add(hash(tuple(back[at:end][::-1])))
        total -= count[at]
    return out - {None}


def chains(pairs: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """All pairs dealt to sequences that increase in both places; each pair goes on the sequence that ends closest below it."""
    ends: list[int] = []
    made: list[list[tuple[int, int]]] = []
    for i, j in sorted(pairs, key=lambda p: (p[0], -p[1])):
        # Ends fall along the list, so their negatives rise.
        at = bisect_right(ends, -j)
        if at == len(ends):
            ends.append(-j)
            made.append([(i, j)])
        else:
            ends[at] = -j
            made[at].append((i, j))
    return made


def common_blocks(a: list[int], a_words: list[int], b: list[int], b_words: list[int], block_words: int = BLOCK_WORDS) -> list[int]:
    """Positions of b in aligned blocks that a holds too. Lines are given by hashes and words; those without a word match nothing."""
    ia, ib = ([i for i, w in enumerate(ws) if w > 0] for ws in (a_words, b_words))
    x, y = [a[i] for i in ia], [b[i] for i in ib]
    a_keys, _ = runs(x, [a_words[i] for i in ia], block_words)
    b_keys, sizes = runs(y, [b_words[i] for i in ib], block_words)
    both = set(a_keys) & set(b_keys) - {None}
    of_a, of_b = ([i for i, k in enumerate(keys) if k in both] for keys in (a_keys, b_keys))
    gone: set[int] = set()

    def take(i: int, j: int) -> None:
        lo, hi = 0, sizes[j]
        while i + hi < len(x) and j + hi < len(y) and j + hi not in gone and x[i + hi] == y[j + hi]:
            hi += 1
        while i - lo > 0 and j - lo > 0 and j - lo - 1 not in gone and x[i - lo - 1] == y[j - lo - 1]:
            lo += 1
        gone.update(range(j - lo, j + hi))

    met = set()
    for i, j in patience([a_keys[i] for i in of_a], [b_keys[j] for j in of_b]):
        take(of_a[i], of_b[j])
        met.add(of_b[j])
    # What the alignment could not bring into order: its other alignments, all at once. The n-th occurrence goes
    # with the n-th, those beyond with the last.
    where: dict[int, list[int]] = defaultdict(list)
    for i in of_a:
        where[a_keys[i]].append(i)
    seen: Counter = Counter()
    left = []
    for j in of_b:
        if j not in met:
            places = where[b_keys[j]]
            left.append((places[min(seen[b_keys[j]], len(places) - 1)], j))
            seen[b_keys[j]] += 1
    for chain in chains(left):
        for i, j in chain:
            take(i, j)
    out = {ib[j] for j in gone}
    for j in gone:
        if j + 1 in gone:
            out.update(range(ib[j], ib[j + 1]))
    return sorted(out)


def deletions(docs: DataFrame, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, lines): the numbers (from 0) of the lines to delete from each document that loses any; doc is a struct (no_id, id, tie)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    doc = F.struct(F.col("id").isNull().alias("no_id"), F.coalesce("id", F.lit(0)).alias("id"), F.xxhash64("text").alias("tie"))
    words = F.transform(F.split("text", "\n"), lambda x: F.filter(F.split(x, SPACES), lambda w: w != ""))
    split = rows.select(doc.alias("doc"), words.alias("lines"))
    lined = staged(split.select("doc", F.transform("lines", lambda x: F.xxhash64(x)).alias("hashes"), F.transform("lines", lambda x: F.size(x)).alias("words")), "lines")

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [list(keys_of(h[w > 0].tolist(), w[w > 0].tolist(), block_words)) for h, w in zip(pdf["hashes"], pdf["words"], strict=True)]
            yield pdf[["no_id", "id", "tie"]].assign(h=found)

    keyed = lined.select("doc.no_id", "doc.id", "doc.tie", "hashes", "words").mapInPandas(keys, "no_id boolean, id long, tie long, h array<long>")
    anchors = keyed.select(F.struct("no_id", "id", "tie").alias("doc"), F.explode("h").alias("h"))
    firsts = staged(anchors.groupBy("h").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("h", "first"), "firsts")
    pairs = staged(anchors.join(firsts, "h").where("first < doc").select("first", "doc").distinct(), "pairs")
    # Only documents of pairs take part from here on, and few others by chance; the many of one first document are dealt over tasks.
    bits = slot_bits(pairs.select(F.col("doc").alias("term")).union(pairs.select("first")), SLOTS)
    both = staged(lined.where(marked(F.col("doc"), bits.scalar(), SLOTS)).distinct(), "held")
    wide = hot_join(pairs, both.select("doc", "hashes", "words"), "doc", "first", FIRST_ROWS)
    wide = hot_join(wide, both.select(F.col("doc").alias("first"), F.col("hashes").alias("first_hashes"), F.col("words").alias("first_words")), "first", "doc", FIRST_ROWS, pairs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sides = [map(np.ndarray.tolist, pdf[c]) for c in ("first_hashes", "first_words", "hashes", "words")]
            lines = [common_blocks(*x, block_words) for x in zip(*sides, strict=True)]
            out = pdf[["no_id", "id", "tie"]].assign(lines=lines)
            yield out[[len(x) > 0 for x in lines]]

    flat = wide.select("doc.no_id", "doc.id", "doc.tie", "first_hashes", "first_words", "hashes", "words")
    found = flat.mapInPandas(run, "no_id boolean, id long, tie long, lines array<int>")
    return found.groupBy(F.struct("no_id", "id", "tie").alias("doc")).agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("lines"))


def line_dedup(docs: DataFrame, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", removed_col: str | None = "n_removed") -> DataFrame:
    """docs with common blocks deleted from later documents.

    removed_col, if given, has the number of deleted lines. docs is read once for
    the blocks and twice for the result: texts that lose nothing are not shuffled,
    but for those that share the bit of one that does.
    """
    found, found_id = staged(deletions(docs, block_words, id_col, text_col), "gone"), F.when(~F.col("doc.no_id"), F.col("doc.id"))
    gone = found.select(found_id.alias("_id"), F.col("doc.tie").alias("_tie"), F.col("lines").alias("_lines"))
    whole = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    doc_id, tie = docs[id_col].cast("long"), F.xxhash64(whole)
    bits = slot_bits(found.select(F.xxhash64(found_id, "doc.tie").alias("term")), SLOTS)
    met = marked(F.xxhash64(doc_id, tie), bits.scalar(), SLOTS)
    # A merge join, as gone grows with the data: broadcast, it would only do while that is small.
    wide = docs.where(met).join(gone.hint("merge"), doc_id.eqNullSafe(gone["_id"]) & (tie == gone["_tie"]), "left")
    lines = gone["_lines"]
    dead = F.map_from_arrays(lines, lines)
    kept = F.array_join(F.filter(F.split(whole, "\n"), lambda x, i: ~F.map_contains_key(dead, i)), "\n")

    def result(part: DataFrame, text: Column, removed: Column) -> DataFrame:
        out = [text.alias(c) if c == text_col else docs[c] for c in docs.columns if c != removed_col]
        return part.select(*out, *([removed.cast("long").alias(removed_col)] if removed_col else []))

    cut = result(wide, F.when(lines.isNotNull(), kept).otherwise(docs[text_col]), F.coalesce(F.size(lines), F.lit(0)))
    return cut.union(result(docs.where(~met), docs[text_col].cast("string"), F.lit(0)))
