"""Order MinHash fingerprints, in DataFrame operations throughout.

(Marcais et al., "Locality-sensitive hashing for the edit distance", 2019.) A text is a sequence of
tokens: words, cut after ``TOKEN_CHARS`` characters, and single characters of scripts written without
spaces. Its k-mers (k consecutive tokens) are numbered by occurrence, so that the second "a b" differs from
the first. For each element of the signature one permutation of the numbered k-mers is looked at; the
``TUPLE`` least of them are put back into text order and hashed together. Two texts share an element if the
same k-mers are least in both and stand in the same order, which tracks edit distance, not only content.

The permutations are the rotations of one: element j orders k-mers by their hash from j / elements of the
range on, around the end (a circulant MinHash). One sorted array per text then serves all elements: the
least k-mers of an element follow its threshold in that array. All of it is arrays of longs inside a row;
nothing is exploded and only text that must meet another text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenemill.llm.common import materialise, text_of

KMER = 2
TUPLE = 2
ELEMENTS = 64
TOKEN_CHARS = 12

#: A packed k-mer: the high 40 bits of its hash, then its place (from 1) in 24 bits; a place of 0 marks a threshold.
_PLACE_BITS = 24
_PLACE = (1 << _PLACE_BITS) - 1

_DENSE = r"\u0E00-\u0E7F\u1000-\u109F\u2E80-\u9FFF\uF900-\uFAFF"
_WORDS = rf"[^\x20\x09-\x0D]{{1,{TOKEN_CHARS}}}"
_DENSE_WORDS = rf"[{_DENSE}]|[^\x20\x09-\x0D{_DENSE}]{{1,{TOKEN_CHARS}}}"


def _tokens(text: Column) -> Column:
    """Words of a text; the pattern that knows scripts without spaces is slow, and used where one occurs."""
    dense = (F.octet_length(text) > F.char_length(text)) & text.rlike(f"[{_DENSE}]")
    every = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(dense, every(_DENSE_WORDS)).otherwise(every(_WORDS))


def _let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _numbered(ordered: Column) -> Column:
    """Of sorted packed k-mers: the same with each hash but that of a first occurrence mixed with its occurrence number.

    Equal hashes stand next to each other in text order, so an element is a later occurrence if its
    neighbour has its hash; among the later ones alone, runs of equal hashes give the numbers.
    """
    same = lambda x, y: x.bitwiseXOR(y).bitwiseAND(F.lit(~_PLACE)) == 0

    def of_later(later: Column) -> Column:
        def of_starts(starts: Column) -> Column:
            lengths = F.transform(starts, lambda s, j: F.coalesce(F.get(starts, j + 1), F.size(later)) - s)
            return F.flatten(F.transform(lengths, lambda k: F.sequence(F.lit(1), k)))

        new = F.filter(F.sequence(F.lit(0), F.size(later) - 1), lambda i: (i == 0) | ~same(F.get(later, i), F.get(later, i - 1)))
        rehash = lambda x, number: F.xxhash64(x.bitwiseAND(F.lit(~_PLACE)), number).bitwiseAND(F.lit(~_PLACE)).bitwiseOR(x.bitwiseAND(F.lit(_PLACE)))
        numbered = _let(_let(new, of_starts), lambda o: F.transform(later, lambda x, i: rehash(x, F.get(o, i))))
        return F.when(F.size(later) == 0, ordered).otherwise(F.concat(F.array_except(ordered, later), numbered))

    return _let(F.filter(ordered, lambda x, i: same(x, F.get(ordered, i - 1))), of_later)


def signature(text: Column, elements: int = ELEMENTS, kmer: int = KMER, tuple_: int = TUPLE) -> Column:
    """``array<long>`` of ``elements`` hashes; empty for a text without tokens.

    A text of fewer tokens than a k-mer has is one k-mer; where there are fewer k-mers than a tuple takes,
    they are taken around again. Places beyond 2^24 are coarsened, so that only the order of close k-mers
    of very long texts may be lost.
    """
    if elements & (elements - 1):
        raise ValueError("the number of elements must be a power of two")
    step = (1 << 64) // elements
    thresholds = F.array(*[F.lit(-(1 << 63) + j * step) for j in range(elements)])

    def of_hashes(h: Column) -> Column:
        n = F.greatest(F.size(h) - (kmer - 1), F.least(F.size(h), F.lit(1)))

        def of_count(n: Column) -> Column:
            # Never null, so that arrays of packed k-mers are sorted as plain longs.
            shift = F.coalesce(F.greatest(F.ceil(F.log2((n + 1).cast("double") / float(1 << _PLACE_BITS))).cast("int"), F.lit(0)), F.lit(0))

            def packed(shift: Column) -> Column:
                return F.transform(
                    F.slice(h, 1, n),
                    lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, kmer)])
                    .bitwiseAND(F.lit(~_PLACE))
                    .bitwiseOR(F.call_function("shiftright", i, shift).cast("long") + F.lit(1)),
                )

            ordered = F.sort_array(_let(shift, packed))
            return _let(_let(ordered, _numbered), lambda kmers: of_kmers(kmers, n))

        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(_let(n, of_count))

    def of_kmers(kmers: Column, n: Column) -> Column:
        def least(ranks: Column, sorted_: Column) -> Column:
            def element(rank: Column, j: Column) -> Column:
                taken = F.transform(
                    F.sequence(F.lit(0), F.lit(tuple_ - 1)),
                    lambda t: _let(
                        F.get(sorted_, F.pmod(rank - j + t, n)),
                        lambda x: F.shiftleft(x.bitwiseAND(F.lit(_PLACE)), 64 - _PLACE_BITS).bitwiseOR(F.shiftrightunsigned(x, _PLACE_BITS)),
                    ),
                )
                in_order = F.transform(F.sort_array(taken), lambda x: x.bitwiseAND(F.lit((1 << (64 - _PLACE_BITS)) - 1)))
                return F.xxhash64(in_order)

            return F.transform(ranks, element)

        def split(both: Column) -> Column:
            ranks = F.filter(F.sequence(F.lit(0), F.size(both) - 1), lambda i: F.get(both, i).bitwiseAND(F.lit(_PLACE)) == 0)
            return _let(ranks, lambda r: _let(F.sort_array(kmers), lambda s: least(r, s)))

        return _let(F.sort_array(F.concat(kmers, thresholds)), split)

    hashes = F.transform(_tokens(text), lambda w: F.xxhash64(w))
    return _let(hashes, of_hashes)


def as_hex(sig: Column) -> Column:
    """A signature as text: the low 32 bits of each element in 8 hex digits."""
    return F.array_join(F.transform(sig, lambda s: F.lpad(F.lower(F.hex(s.bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of elements that two signatures have in common; texts without tokens are alike."""
    n = F.greatest(F.size(a), F.size(b))
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda s: s))
    return F.when(n == 0, F.lit(1.0)).otherwise(same / n.cast("double"))


def next_in_order(keys: DataFrame, by: list[Column], carry: list[str]) -> DataFrame:
    """``keys`` with ``next_<c>`` for each of ``carry``: the row that follows in the order ``by``, around the end.

    Rows are range-partitioned; within a range a window finds the next row, and only the first row of
    each range is handed to the range before it.
    """
    ranged = materialise(keys.repartitionByRange(*by).withColumn("__range", F.spark_partition_id()), "order-ranges")
    w = Window.partitionBy("__range").orderBy(*by)
    row = F.struct(*carry)
    inside = ranged.withColumns({"__next": F.lead(row).over(w), "__nth": F.row_number().over(w)})
    inside = materialise(inside, "order-inside")
    heads = inside.where("__nth = 1").select("__range", row.alias("__head"))
    ranges = Window.orderBy("__range")  # one row per range
    following = F.coalesce(F.lead("__head").over(ranges), F.first("__head").over(ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = materialise(heads.select(F.col("__range").alias("__of"), following.alias("__following")), "order-heads")
    last = inside.where("__next is null").join(heads, F.col("__range") == F.col("__of")).withColumn("__next", F.col("__following"))
    both = inside.where("__next is not null").select(*keys.columns, "__next").unionByName(last.select(*keys.columns, "__next"))
    return both.select(*keys.columns, *[F.col(f"__next.{c}").alias(f"next_{c}") for c in carry])


def order_minhash_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, fingerprint`` of each row; null texts count as empty, whose fingerprint is the empty string."""
    return docs.select(F.col(id_col), as_hex(signature(text_of(text_col))).alias("fingerprint"))


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    The next row is that of the next lower id, after the lowest the highest; a null id is the lowest and
    rows that share an id follow by a hash of their text. The edited text has its last third (rounded
    down) replaced by as many characters from the start of the next text, or all it has. Rows that repeat
    both id and text count once in this order and give repeated results. Null texts count as empty; extra
    columns are ignored; an empty table gives an empty result.
    """
    text = text_of(text_col)
    id_ = F.col(id_col).cast("long")
    rows = docs.select(F.coalesce(id_, F.lit(-(1 << 63))).alias("id"), F.xxhash64(text, id_.isNull()).alias("key"), id_.isNull().alias("no_id"), text.alias("text"))
    keys = rows.groupBy("id", "key", "no_id").agg(F.count("*").alias("copies"), F.max(F.char_length("text")).cast("long").alias("n"))
    keys = materialise(keys, "omh-keys")
    if not keys.where("copies > 1").isEmpty():
        rows = rows.dropDuplicates(["id", "key"])
    links = materialise(next_in_order(keys, [F.col("no_id"), F.desc("id"), F.col("key")], ["id", "key"]), "omh-links")
    back = links.select(
        F.col("next_id").alias("id"), F.col("next_key").alias("key"), F.col("id").alias("before_id"), F.col("key").alias("before_key"),
        F.floor(F.col("n") / 3).cast("int").alias("wanted"),
    )
    signed = materialise(rows.select("id", "key", signature(F.col("text")).alias("sig")), "omh-signatures")
    # The one shuffle of whole texts: each goes to its key, to be cut and to lend its start to the row before.
    met = rows.select("id", "key", "text").join(materialise(links.select("id", "key", "n").join(back, ["id", "key"]), "omh-back"), ["id", "key"])
    kept = met.select("id", "key", F.substring("text", F.lit(1), (F.col("n") - F.floor(F.col("n") / 3)).cast("int")).alias("head"))
    lent = met.select(F.col("before_id").alias("id"), F.col("before_key").alias("key"), F.substring("text", F.lit(1), F.col("wanted")).alias("start"))
    edited = kept.join(lent, ["id", "key"]).select("id", "key", F.concat("head", "start").alias("edited"))
    edited = edited.select("id", "key", F.sha2("edited", 256).alias("edited_sha256"), signature(F.col("edited")).alias("edited_sig"))
    edited = materialise(edited, "omh-edited")
    following = signed.select(F.col("id").alias("next_id"), F.col("key").alias("next_key"), F.col("sig").alias("next_sig"))
    found = (
        links.join(signed, ["id", "key"])
        .join(edited, ["id", "key"])
        .join(following, ["next_id", "next_key"])
        .withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    )
    return found.select(
        F.when(~F.col("no_id"), F.col("id")).alias(id_col), F.col("n").alias("n_chars"), "edited_sha256", as_hex(F.col("sig")).alias("fingerprint"),
        as_hex(F.col("edited_sig")).alias("edited_fingerprint"), likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
