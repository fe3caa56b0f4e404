"""Spelling variants: words one edit apart, found in bit-sliced position indexes, and the common form each leads to.

One edit leaves a word's first or its last half as it was, so words are dealt by either half.  In each group the words of
one length make an index: for a position and a letter, a bitset of the words that have that letter there.  All queries of
the group go through the positions together and keep two bitsets each: the words met without an error so far and those
met with one; a left-out letter is the same recurrence against the bitsets of the position before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revcast.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT, FORM_RATIO, DELETED_IN = 7, 2, 10, 31
GROUP_ROWS = 20_000
INDEX_WORDS, INDEX_LETTERS, QUERY_CELLS = 2048, 8_000_000, 4_000_000
FOUND = "word string, n_near long, best_n long, best string"


def lower_ascii(word: Column) -> Column:
    """A-Z in lower case and nothing else; a word of ASCII only can take Spark's faster way."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def vocabulary(docs: DataFrame) -> DataFrame:
    """The distinct words (word, n) of whole texts that have at least 7 code points and 2 occurrences.

    A run of the given letters of fewer than 7 can only become shorter, so runs are looked for from 7 on.  Occurrences are
    combined before the shuffle, however common a word is.
    """
    runs = docs.select(F.col("doc_id"), F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-zÀ-ÿ]{7,}"), 0)).alias("run"))
    runs = runs.select(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":")).alias("id"), lower_ascii(F.col("run")).alias("run"))
    h = F.crc32(F.concat("id", "run").cast("binary"))
    marked = runs.select("run", F.when(h % DELETED_IN == 0, (h % F.char_length("run")).cast("int")).alias("cut"))
    shorter = F.concat(F.expr("substring(run, 1, cut)"), F.expr("substring(run, cut + 2, char_length(run))"))
    words = marked.select(F.when(F.col("cut").isNull(), F.col("run")).otherwise(shorter).alias("word"))
    return words.where(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def halves(words: DataFrame) -> DataFrame:
    """Each word under its first and its last half, by the length of the shorter word of a pair: its own, and one less.

    With the length m of the shorter word and h = m // 2, an edit at place h or later leaves the first h letters, an
    earlier one the last m - h.  Halves travel as hashes: the recurrences compare all letters anyway.
    """
    size = F.char_length("word")
    parts = []
    for less in (0, 1):
        m = size - less
        h = F.floor(m / 2).cast("int")
        parts += [F.struct(F.lit("first").alias("side"), m.cast("int").alias("size"), F.xxhash64(m, F.substring(F.col("word"), F.lit(1), h)).alias("half"))]
        parts += [F.struct(F.lit("last").alias("side"), m.cast("int").alias("size"), F.xxhash64(-m, F.substring(F.col("word"), size - (m - h) + 1, m - h)).alias("half"))]
    return words.select("word", "n", F.explode(F.array(*parts)).alias("at")).select("at.*", "word", "n")


class Index:
    """Bitsets over words of one length (rows of code points), made position by position as the recurrences ask."""

    def __init__(self, codes: np.ndarray, alphabet: np.ndarray):
        self.codes, self.alphabet = codes, alphabet
        self.words = -(-len(codes) // 64)

    def all(self) -> np.ndarray:
        bits = np.zeros(self.words * 64, dtype=np.uint8)
        bits[: len(self.codes)] = 1
        return np.packbits(bits, bitorder="little").view(np.uint64)

    def at(self, position: int) -> np.ndarray:
        """(letter, words / 64): who has which letter at a position; the last row is a letter that no word has."""
        bits = np.zeros((len(self.alphabet) + 1, self.words * 64), dtype=np.uint8)
        bits[:-1, : len(self.codes)] = self.codes[:, position] == self.alphabet[:, None]
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def replaced(index: Index, letters: np.ndarray, first: bool) -> np.ndarray:
    """Words that differ from each query (rows of letter numbers, of the index's length) in exactly one place.

    The place is in the second half if ``first`` (the half that is the same), else in the first half.
    """
    size = letters.shape[1]
    half = size // 2
    zero = np.repeat(index.all()[None, :], len(letters), axis=0)
    one = np.zeros_like(zero)
    for i in range(size):
        here = index.at(i)[letters[:, i]]
        one &= here
        if (i >= half) == first:
            one |= zero & ~here
        zero &= here
    return one


def shortened(index: Index, letters: np.ndarray, first: bool) -> np.ndarray:
    """Words that are a query (one letter longer than the index's words) without one letter.

    Of equal letters side by side only the first counts as left out, so a word is found by one place, which is in the
    second half if ``first``, else in the first half.
    """
    size = letters.shape[1]
    half = (size - 1) // 2
    zero = np.repeat(index.all()[None, :], len(letters), axis=0)
    one = np.zeros_like(zero)
    before = None
    for i in range(size):
        if before is not None:
            one &= before[letters[:, i]]
        if (i >= half) == first:
            new = letters[:, i] != letters[:, i - 1] if i else np.ones(len(letters), dtype=bool)
            one |= np.where(new[:, None], zero, np.uint64(0))
        if i < size - 1:
            before = index.at(i)
            zero &= before[letters[:, i]]
    return one


def members(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, word) of every bit that is set."""
    rows, cells = np.nonzero(bits)
    if not len(rows):
        return rows, cells
    at, bit = np.nonzero(np.unpackbits(bits[rows, cells].view(np.uint8).reshape(len(rows), 8), axis=1, bitorder="little"))
    return rows[at], cells[at] * 64 + bit


def _codes(words: list[str], size: int) -> np.ndarray:
    return np.array(words, dtype=f"U{size}").view(np.uint32).reshape(len(words), size)


def near_pairs(indexed: list[str], queries: list[str], size: int, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """(query, indexed word) of the words of ``size`` letters that one edit parts, the half being the same.

    Queries have ``size`` letters (one is replaced) or one more (one is left out).
    """
    found = [np.zeros((2, 0), dtype=np.int64)]
    step = max(1, min(INDEX_WORDS, INDEX_LETTERS // size))
    groups = [(extra, [k for k, q in enumerate(queries) if len(q) == size + extra]) for extra in (0, 1)]
    for start in range(0, len(indexed), step):
        block = _codes(indexed[start : start + step], size)
        alphabet = np.unique(block)
        index = Index(block, alphabet)
        for extra, rows in groups:
            many = max(1, min(QUERY_CELLS // index.words, INDEX_LETTERS // (size + extra)) // 16)
            for at in range(0, len(rows), many):
                part = np.array(rows[at : at + many])
                codes = _codes([queries[k] for k in part], size + extra)
                spot = np.searchsorted(alphabet, codes)
                letters = np.where((spot < len(alphabet)) & (alphabet[np.minimum(spot, len(alphabet) - 1)] == codes), spot, len(alphabet))
                q, w = members((shortened if extra else replaced)(index, letters, first))
                found.append(np.stack([part[q], w + start]))
    pairs = np.concatenate(found, axis=1)
    return pairs[0], pairs[1]


def _summed(table: pa.Table) -> pa.Table:
    """What one group finds: per word, its near words' number and the most common of them.

    Words of a side and length are taken in the order of their halves, in blocks, so a query meets its own half's words.
    """
    side, size, role = (np.array(table.column(c).to_pylist()) for c in ("side", "size", "role"))
    words, counts, half = table.column("word").to_pylist(), table.column("n").to_numpy(), table.column("half").to_numpy()
    near: dict[int, list] = {}

    def meet(a: int, b: int) -> None:
        rank = (-counts[b], words[b])
        seen = near.get(a)
        if seen is None:
            near[a] = [1, rank]
        else:
            seen[0] += 1
            seen[1] = min(seen[1], rank)

    for kind, m in sorted(set(zip(side.tolist(), size.tolist()))):
        own = np.flatnonzero((side == kind) & (size == m))
        own = own[np.argsort(half[own], kind="stable")]
        edges = np.flatnonzero(np.concatenate(([True], half[own][1:] != half[own][:-1], [True])))
        start = 0
        while start < len(edges) - 1:
            end = start + 1
            while end < len(edges) - 1 and edges[end + 1] - edges[start] <= INDEX_WORDS:
                end += 1
            block = own[edges[start] : edges[end]]
            start = end
            short = [k for k in block if role[k] != "query" and len(words[k]) == m]
            asked = [k for k in block if role[k] != "index"]
            if not short or not asked:
                continue
            q, w = near_pairs([words[k] for k in short], [words[k] for k in asked], m, kind == "first")
            for a, b in zip(q.tolist(), w.tolist()):
                meet(asked[a], short[b])
                if len(words[asked[a]]) > m:
                    meet(short[b], asked[a])
    rows = sorted(near)
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
    return pa.table([[words[k] for k in rows], [near[k][0] for k in rows], [-int(near[k][1][0]) for k in rows], [near[k][1][1] for k in rows]], schema=schema)


def dealt(placed: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Rows of ``halves`` by bucket: halves share buckets of about ``group_rows``; a more common half has tiles of its own.

    Such a half is cut into k parts, and each part meets each other as index and query in one of k * k tiles, so no task
    holds a whole common half.  ``placed`` must be a stored table.
    """
    buckets = max(1, placed.count() // group_rows)
    common = placed.groupBy("side", "size", "half").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > group_rows)
    common = common.select("side", "size", "half", F.ceil(F.col("rows") / group_rows).cast("int").alias("k"))
    rows = placed.join(common, ["side", "size", "half"], "left")
    plain = rows.where("k is null").select("side", "size", "half", "word", "n", F.lit("both").alias("role"), F.pmod("half", F.lit(buckets)).alias("bucket"))
    cut = rows.where("k is not null").withColumn("part", F.pmod(F.xxhash64("word"), F.col("k")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    tiles = [
        cut.select("*", other.alias("across")).select("side", "size", "half", "word", "n", F.lit(role).alias("role"), F.xxhash64("half", *order).alias("bucket"))
        for role, order in (("index", ("part", "across")), ("query", ("across", "part")))
    ]
    return plain.unionByName(tiles[0]).unionByName(tiles[1])


def near_words(words: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """For every word of a stored table (word, n) with near words: their number and the largest (n, then word) of them."""
    placed = stored(halves(words), "spelling-halves")
    found = dealt(placed, group_rows).groupBy("bucket").applyInArrow(_summed, FOUND)
    ranked = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))).alias("best"))
    return ranked.select("word", "n_near", (-F.col("best.m")).alias("best_n"), F.col("best.w").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for words that have a form (word, form): each round doubles how far a word has followed its forms.

    A form is at least ten times as common as its word, so chains end, after as many steps as the largest count has digits.
    """
    at = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = at.select(F.col("word").alias("step"), F.col("root").alias("beyond"))
        moved = stored(at.join(ahead, F.col("root") == F.col("step"), "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "spelling-roots")
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at


def variant_groups(docs: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per word of ``vocabulary``: word, form, root, n, n_near, form_n.

    Two words are near if one inserted, deleted or replaced code point parts them; a word's form is its most common near
    word (ties: smallest in code-point order) if that is at least ten times as common, else null.  Null texts have no
    words; a null doc_id counts as an empty one in the checksum; rows that repeat are counted each.  A text, and a word, may
    be of any length; letters outside the given ranges part words.  An empty table gives an empty result; other columns are not read.
    """
    words = stored(vocabulary(docs), "spelling-words")
    near = near_words(words, group_rows).withColumnRenamed("word", "of")
    is_form = F.col("best_n") >= FORM_RATIO * F.col("n")
    formed = words.join(near, F.col("word") == F.col("of"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")
    )
    formed = stored(formed, "spelling-forms")
    ends = roots(formed.where("form is not null").select("word", "form")).withColumnRenamed("word", "of")
    out = formed.join(ends, F.col("word") == F.col("of"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
