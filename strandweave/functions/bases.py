"""Column functions over DNA strings. All are built-in expressions, so they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blanks that may surround a name or a k-mer.
BLANKS = " \t\r\n\f\x0b"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(BLANKS))


def clean_name(c: Column | str) -> Column:
    """A reference's name without surrounding blanks and leading ``>`` (null stays null)."""
    return F.ltrim(F.rtrim(col(c), F.lit(BLANKS)), F.lit(BLANKS + ">"))


def revcomp(c: Column | str) -> Column:
    """Reverse complement; letters outside ACGT stay as they are."""
    return F.translate(F.reverse(col(c)), "ACGT", "TGCA")


def canonical(c: Column | str) -> Column:
    """The smaller of a k-mer and its reverse complement, compared from the last base on."""
    c = col(c)
    rc = revcomp(c)
    return F.when(F.reverse(rc) < F.reverse(c), rc).otherwise(c)


def is_acgt(c: Column | str) -> Column:
    return F.translate(col(c), "ACGT", "") == ""


def is_palindrome(c: Column | str) -> Column:
    return col(c) == revcomp(c)


def code(c: Column | str) -> Column:
    """ACGT string of up to 31 letters as BIGINT, two bits a base and the last base highest: codes sort as k-mers do."""
    return F.conv(F.translate(F.reverse(col(c)), "ACGT", "0123"), 4, 10).cast("bigint")


def canonical_code(c: Column | str) -> Column:
    """``code`` of the canonical form. Complementing in place of reversing gives the other strand's code."""
    c = col(c)
    return F.least(code(c), F.conv(F.translate(c, "ACGT", "3210"), 4, 10).cast("bigint"))


def decode(c: Column | str, k: int) -> Column:
    """The k letters of a ``code``."""
    return F.reverse(F.translate(F.lpad(F.conv(col(c).cast("string"), 10, 4), k, "0"), "0123", "ACGT"))


def longest_segment(c: Column | str, gap: str = "N") -> Column:
    """Longest part between ``gap`` letters, the first of equals; empty text gives empty text."""
    return F.aggregate(F.split(col(c), gap), F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))


def trim_right(c: Column | str, n: int) -> Column:
    c = col(c)
    return F.substring(c, F.lit(1), F.greatest(F.length(c) - F.lit(n), F.lit(0)))


def trim_error(c: Column | str) -> Column:
    """Without the letters after the last ACGT."""
    return F.regexp_replace(col(c), "[^ACGT]+$", "")


def encode_digits(c: Column | str) -> Column:
    return F.translate(col(c), "ACGTN", "01234")


def decode_digits(c: Column | str) -> Column:
    return F.translate(col(c), "01234", "ACGTN")


def windows(seq: Column | str, k: int) -> Column:
    """Array of the k-letter windows; empty where the sequence is null or shorter than k."""
    seq = col(seq)
    return F.when(F.length(seq) >= k, F.transform(F.sequence(F.lit(1), F.length(seq) - (k - 1)), lambda i: F.substring(seq, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def merge_overlap(a: Column | str, b: Column | str, k: int) -> Column:
    """Two contigs that share k-1 bases."""
    return F.concat(col(a), F.substring(col(b), F.lit(k), F.length(col(b))))


def merge_gap(a: Column | str, b: Column | str, gap: Column) -> Column:
    """Two contigs with ``gap`` N between them, or -gap letters of the second dropped if it is negative."""
    b = col(b)
    return F.concat(col(a), F.when(gap > 0, F.repeat(F.lit("N"), gap)).otherwise(F.lit("")), F.when(gap < 0, F.substring(b, 1 - gap, F.length(b))).otherwise(b))


def coverage(sum_cov: Column | str, length: Column | str, k: int) -> Column:
    """Summed k-mer count over the number of windows; null where the contig is shorter than k."""
    n = col(length) - (k - 1)
    return F.when(n > 0, col(sum_cov) / n)


def degree(mask: Column | str) -> Column:
    return F.bit_count(col(mask))


def saturated(c: Column | str, cap: int = 65535) -> Column:
    return F.least(col(c), F.lit(cap))


def word(c: Column | str) -> Column:
    """ACGT string of up to 31 letters as BIGINT, two bits a base and the first base highest: words sort as strings do."""
    return F.conv(F.translate(col(c), "ACGT", "0123"), 4, 10).cast("bigint")


def word_text(c: Column | str, k: int) -> Column:
    """The k letters of a ``word``."""
    return F.translate(F.lpad(F.conv(col(c).cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def other_strand(c: Column | str, k: int) -> Column:
    """The ``word`` of the reverse complement: all bits turned, then pairs of bits swapped in steps of doubled width."""
    c = F.bitwise_not(col(c))
    for width, low in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        mask = F.lit(low).cast("bigint")
        c = F.shiftrightunsigned(c, width).bitwiseAND(mask).bitwiseOR(F.shiftleft(c.bitwiseAND(mask), width))
    return F.shiftrightunsigned(c, 64 - 2 * k)


class Vertices:
    """What the graph asks of oriented k-mers, written as strings or, for k up to 31, as words; both sort alike."""

    def __init__(self, k: int, coded: bool) -> None:
        if coded and not 0 < k <= 31:
            raise ValueError("words need their k, of at most 31")
        self.k, self.coded = k, coded

    @classmethod
    def like(cls, df: DataFrame, column: str, k: int) -> Vertices:
        """As the column of ``df`` holds them."""
        return cls(k, df.schema[column].dataType.typeName() == "long")

    def turned(self, c: Column | str) -> Column:
        return other_strand(c, self.k) if self.coded else revcomp(c)

    def canonical(self, c: Column | str) -> Column:
        return F.least(col(c), self.turned(c))

    def of(self, text: Column | str) -> Column:
        return word(text) if self.coded else col(text)

    def text(self, c: Column | str) -> Column:
        return word_text(c, self.k) if self.coded else col(c)

    def following(self, c: Column | str, base: Column) -> Column:
        """The vertex that leaves out the first base and ends with ``base`` (0 to 3)."""
        if self.coded:
            return F.shiftleft(col(c), 2).bitwiseAND(F.lit((1 << 2 * self.k) - 1).cast("bigint")).bitwiseOR(base.cast("bigint"))
        return F.concat(F.substring(col(c), 2, self.k - 1), self.letter(base))

    def last(self, c: Column | str) -> Column:
        """The letter of the last base."""
        return self.letter(col(c).bitwiseAND(F.lit(3).cast("bigint"))) if self.coded else F.right(col(c), F.lit(1))

    @staticmethod
    def letter(base: Column) -> Column:
        return F.substring(F.lit("ACGT"), (base + 1).cast("int"), F.lit(1))
