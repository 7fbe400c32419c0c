"""Sequence expressions: case folding, strands, shingling, hashing.

Shingles come from one look-ahead regular expression, so enumerating them is linear in the text
(``substring(text, i, k)`` is linear in ``i`` for UTF-8 strings and hence quadratic over a text)
and an alphabet restriction costs nothing extra: with ``alphabet='ACGT'`` the pattern only ever
matches windows made of those letters, which is the same as splitting the text on every other
letter first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The ASCII letters, the four bases and their complements.
LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DNA = "ACGT"
COMPLEMENT = "TGCA"

# Starts per piece. A piece is the unit of in-row work, so this bounds the arrays built per row.
PIECE = 16_384


def ascii_upper(col: Column | str) -> Column:
    """Upper-case ASCII letters only, so that no text changes its length.

    For a pure ASCII text that is what ``upper`` does, several times faster than ``translate``.
    """
    return F.when(F.octet_length(col) == F.length(col), F.upper(col)).otherwise(F.translate(col, LOWER, UPPER))


def reverse_complement(col: Column | str) -> Column:
    return F.reverse(F.translate(col, DNA, COMPLEMENT))


def canonical(col: Column) -> Column:
    """The lexicographically smaller one of a shingle and its reverse complement."""
    return F.least(col, reverse_complement(col))


def basename(col: Column | str) -> Column:
    return F.element_at(F.split(col, "/"), -1)


# -- hashing -----------------------------------------------------------------------------------

Hasher = Callable[[Column], Column]


def fast_hash(col: Column) -> Column:
    """64-bit hash folded to non-negative; stays in generated code."""
    return F.xxhash64(col).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def portable_hash(col: Column) -> Column:
    """The first 60 bits of MD5: about twice as slow, but reproducible outside Spark."""
    return F.conv(F.substring(F.md5(col), 1, 15), 16, 10).cast("bigint")


HASHERS = {hasher.__name__: hasher for hasher in (fast_hash, portable_hash)}


# -- shingling ---------------------------------------------------------------------------------


def _unit(alphabet: str | None) -> str:
    return f"[{alphabet}]" if alphabet else "."


def pieces(col: Column | str, overlap: int, step: int = PIECE) -> Column:
    """Cut a text into an array of pieces of ``step`` letters plus ``overlap`` letters of the next."""
    cut = F.regexp_extract_all(col, F.lit(f"(?s)(?=(.{{1,{step + overlap}}})).{{1,{step}}}"), F.lit(1))
    column = F.col(col) if isinstance(col, str) else col
    return F.when(F.length(column) <= step, F.array(column)).otherwise(cut)


def shingles(col: Column | str, k: int, alphabet: str | None = None) -> Column:
    """All length-``k`` windows over ``alphabet`` (any letter if None), one per start position."""
    return F.regexp_extract_all(col, F.lit(f"(?s)(?=({_unit(alphabet)}{{{k}}}))."), F.lit(1))


def windows(col: Column | str, shortest: int, longest: int) -> Column:
    """One window per start position: ``longest`` letters, or fewer (>= shortest) at the end."""
    return F.regexp_extract_all(col, F.lit(f"(?s)(?=(.{{{shortest},{longest}}}))."), F.lit(1))


def explode_pieces(
    sequences: DataFrame, overlap: int, step: int = PIECE, uppercase: bool = True, spread: int | None = None
) -> DataFrame:
    """``(name, seq)`` to ``(name, piece)``.

    ``spread`` redistributes the pieces over that many tasks; use it when the input cannot be
    split, such as a few huge compressed files. Without it the text is worked on where it is read.
    """
    text = ascii_upper("seq") if uppercase else F.col("seq")
    out = sequences.select("name", text.alias("seq")).select(
        "name", F.explode(pieces("seq", overlap, step)).alias("piece")
    )
    return out.repartition(spread) if spread else out


def explode_shingles(
    sequences: DataFrame,
    k: int,
    alphabet: str | None = DNA,
    uppercase: bool = True,
    step: int = PIECE,
    spread: int | None = None,
) -> DataFrame:
    """``(name, seq)`` to one row ``(name, kmer)`` per shingle occurrence."""
    cut = explode_pieces(sequences, k - 1, step, uppercase, spread)
    return cut.select("name", F.explode(shingles("piece", k, alphabet)).alias("kmer"))


def by_length(sequences: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """``(name, texts)`` of the sets with at most ``most`` letters, whole, and the rows ``(name, seq)`` of the longer ones.

    A row counts as a letter too. The longer ones are few, as ``most`` bounds how many the input can hold.
    """
    rows = sequences.select("name", "seq")
    letters = F.sum(F.coalesce(F.length("seq"), F.lit(0)) + F.lit(1))
    long = rows.groupBy("name").agg(letters.alias("letters")).where(F.col("letters") > most)
    long = F.broadcast(long.select(F.col("name").alias("long")))
    own = F.col("name").eqNullSafe(F.col("long"))
    short = rows.join(long, own, "left_anti").groupBy("name").agg(F.collect_list("seq").alias("texts"))
    return short, rows.join(long, own, "left_semi")


# -- a DNA image of ordinary text --------------------------------------------------------------

# Each letter (and the space) takes one base, in turn; other letters stay ambiguous.
DNA_FROM = UPPER + " "
DNA_TO = (DNA * 7)[: len(DNA_FROM)]


def dna_projection(col: Column | str) -> Column:
    """Map a text onto the four bases letter by letter; digits and punctuation are kept as they are."""
    return F.translate(col, DNA_FROM + LOWER, DNA_TO + DNA_TO)
